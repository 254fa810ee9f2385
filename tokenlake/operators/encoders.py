"""Word encoders: BPE, WordPiece, word level, Unigram, longest-suffix and longest-substring.

An encoder sees distinct words only: ``encode_words`` runs it in Arrow batches over a dictionary and the result joins
back by word. Vocabularies are model files, small by nature, and travel with the function.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.session import ship_package

Encoder = Callable[[str], list[str]]
LONGEST_WORD = 100


def bpe(merges: Sequence[tuple[str, str]]) -> Encoder:
    """Ranked merges, the best rank first, of equals from the left."""
    rank = {pair: i for i, pair in enumerate(merges)}

    def encode(word: str) -> list[str]:
        parts = list(word)
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: rank.get(p, math.inf))
            if best not in rank:
                break
            out, i = [], 0
            while i < len(parts):
                hit = i + 1 < len(parts) and (parts[i], parts[i + 1]) == best
                out.append(parts[i] + parts[i + 1] if hit else parts[i])
                i += 2 if hit else 1
            parts = out
        return parts

    return encode


def wordpiece(vocab: Sequence[str], unknown: str = "<unk>", mark: str = "##", longest_word: int = LONGEST_WORD) -> Encoder:
    """Longest prefix first, ``##`` on continuations; a word that cannot be finished, or is too long, is unknown as a whole."""
    known = frozenset(vocab)
    longest = max(map(len, known), default=1)

    def encode(word: str) -> list[str]:
        if len(word) > longest_word:
            return [unknown]
        out, at = [], 0
        while at < len(word):
            lead = mark if at else ""
            for end in range(min(len(word), at + longest), at, -1):
                if lead + word[at:end] in known:
                    out.append(lead + word[at:end])
                    at = end
                    break
            else:
                return [unknown]
        return out

    return encode


def word_level(vocab: Sequence[str], unknown: str = "<unk>") -> Encoder:
    known = frozenset(vocab)
    return lambda word: [word if word in known else unknown]


def unigram(scores: dict[str, float], unknown: str = "<unk>", penalty: float = 10.0) -> Encoder:
    """The path of pieces with the highest sum of scores; characters no piece holds are unknown."""
    longest = max(map(len, scores), default=1)
    lowest = min(scores.values(), default=0.0) - penalty

    def encode(word: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = [(best[a][0] + scores[word[a:end]], a) for a in range(max(0, end - longest), end) if word[a:end] in scores]
            best.append(max(options or [(best[end - 1][0] + lowest, end - 1)], key=lambda x: (x[0], -x[1])))
        cuts = [len(word)]
        while cuts[-1]:
            cuts.append(best[cuts[-1]][1])
        pieces = [word[a:b] for a, b in zip(cuts[:0:-1], cuts[-2::-1], strict=True)] if word else []
        return [p if p in scores else unknown for p in pieces]

    return encode


def longest_suffix(vocab: Sequence[str], mark: str = "##") -> Encoder:
    """Peel the longest known suffix (marked unless it is the whole rest); an unmatched head is dropped."""
    known = frozenset(vocab)

    def encode(word: str) -> list[str]:
        out: list[str] = []
        end = len(word)
        while end:
            start = next((a for a in range(end) if (mark if a else "") + word[a:end] in known), None)
            if start is None:
                break
            out.append((mark if start else "") + word[start:end])
            end = start
        return out[::-1]

    return encode


def longest_substring(vocab: Sequence[str], mark: str = "##") -> Encoder:
    """Take the longest known substring again and again (of equals the leftmost); characters never covered are dropped."""
    known = frozenset(vocab)

    def encode(word: str) -> list[str]:
        free = [True] * len(word)
        found: list[tuple[int, str]] = []
        for size in range(len(word), 0, -1):
            for at in range(len(word) - size + 1):
                piece = (mark if at else "") + word[at : at + size]
                if all(free[at : at + size]) and piece in known:
                    found.append((at, piece))
                    free[at : at + size] = [False] * size
        return [piece for _, piece in sorted(found)]

    return encode


def encode_words(words: DataFrame, encoder: Encoder, column: str = "pretoken") -> DataFrame:
    """The rows of a dictionary with ``tokens``."""
    ship_package(words.sparkSession)

    @F.arrow_udf("array<string>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if w is None else encoder(w) for w in batch.to_pylist()], pa.list_(pa.string()))

    return words.withColumn("tokens", encoded(F.col(column)))


def with_ids(encoded: DataFrame, vocab: DataFrame, unknown_id: int) -> DataFrame:
    """Add ``ids`` for ``tokens`` through the vocabulary (token, token_id)."""
    rows = encoded.withColumn("_w", F.monotonically_increasing_id()) if "pretoken" not in encoded.columns else encoded
    key = "pretoken" if "pretoken" in encoded.columns else "_w"
    flat = rows.select(key, F.posexplode("tokens").alias("at", "token")).join(F.broadcast(vocab), "token", "left")
    ids = flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("token_id", F.lit(unknown_id)).alias("id")))), lambda x: x["id"]).alias("ids"))
    return rows.join(ids, key, "left").drop("_w")


def encode_documents(docs: DataFrame, encoder: Encoder) -> DataFrame:
    """(doc_id, tokens, num_tokens): whole texts, by encoding each distinct pre-token once and joining back."""
    from tokenlake.functions import text as tx

    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(tx.pretokens(F.col("text"))).alias("at", "pretoken"))
    known = encode_words(rows.select("pretoken").distinct(), encoder)
    joined = rows.join(known, "pretoken")
    tokens = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "tokens"))), lambda x: x["tokens"]))
    return joined.groupBy("doc_id").agg(tokens.alias("tokens")).withColumn("num_tokens", F.size("tokens"))

"""Tokenizers built from one configuration: normaliser, pre-tokenizer and model.

The configuration is the usual JSON with ``normalizer``, ``pre_tokenizer`` and ``model``, each with a ``type``;
normalisers and pre-tokenizers may be sequences. Texts are normalised and cut by expressions; the model sees each
distinct piece once, in Arrow batches, and its tokens join back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenlake.functions import alphabet, normalise
from tokenlake.functions import text as tx
from tokenlake.operators import encoders

#: Model types by the encoder that serves them.
GREEDY = ("WordPiece", "Sage", "Greedy_Unigram", "Greedy_BPE")
VITERBI = ("Unigram", "SaGe_as_Unigram", "Unigram_equal_like", "BPE_equal_like", "SaGe_equal_like", "WP_equal_like")
MERGING = ("BPE", "BPE_dropout")
SUBSTRINGS = {"flota": "", "WP_flota": "##"}
SUFFIXES = {"longest_suffix": "", "WP_longest_suffix": "##"}
#: Its tokens are marked as continuations, all but a text's first.
REMARKED = "WP_equal_like"
_NORMALISERS = {"BertNormalizer": "Bert"}
_PRE_TOKENIZERS = {"BertPreTokenizer": "Bert"}


def _steps(config: dict | None, inner: str) -> list[dict]:
    if not config:
        return []
    return [s for part in config[inner] for s in _steps(part, inner)] if config["type"] == "Sequence" else [config]


def _precompiled(text: Column, charsmap: str) -> Column:
    @F.arrow_udf("string")
    def mapped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import normalizers

        normal = normalizers.Precompiled(bytes(charsmap, "utf-32")).normalize_str
        for batch in batches:
            yield pa.array([None if t is None else normal(t) for t in batch.to_pylist()], pa.string())

    return mapped(text)


def normalised(text: Column, config: dict | None) -> Column:
    for step in _steps(config, "normalizers"):
        kind, options = step["type"], {k: v for k, v in step.items() if k != "type" and v is not None}
        if kind == "Precompiled":
            text = _precompiled(text, options["precompiled_charsmap"])
            continue
        if isinstance(options.get("pattern"), dict):
            options["pattern"] = next(iter(options["pattern"].values()))
        text = normalise.normalise(text, _NORMALISERS.get(kind, kind), **options)
    return text


def byte_chars(text: Column) -> Column:
    """The text's bytes as characters of the byte alphabet."""
    table = F.array(*(F.lit(alphabet.CHARS[b]) for b in range(256)))
    return F.array_join(F.transform(tx.raw_bytes(text), lambda b: F.get(table, b)), "")


def _pieces(text: Column, step: dict) -> Column:
    kind = step["type"]
    if kind == "ByteLevel":
        whole = tx.prefixed(text) if step.get("add_prefix_space", True) else text
        cut = F.regexp_extract_all(whole, F.lit(tx.PATTERN), F.lit(0)) if step.get("use_regex", True) else F.array(whole)
        return F.transform(F.filter(cut, lambda p: p != ""), byte_chars)
    if kind == "Digits":
        return normalise.pre_tokenize(text, "IndividualDigits" if step.get("individual_digits") else "Digits")
    if kind == "Split":
        return _split(text, step)
    options = {k: v for k, v in step.items() if k in ("delimiter", "replacement")}
    return normalise.pre_tokenize(text, _PRE_TOKENIZERS.get(kind, kind), **options)


def _split(text: Column, step: dict) -> Column:
    """Cut at matches of a pattern, which go, stand alone, or join what is before or behind them."""
    source = step["pattern"]
    pattern = source["Regex"] if "Regex" in source else r"\Q" + source["String"] + r"\E"
    mark, behaviour = "\x01", step.get("behavior", "Isolated").lower()
    ways = {"removed": mark, "isolated": f"{mark}$0{mark}", "mergedwithprevious": f"$0{mark}", "mergedwithnext": f"{mark}$0"}
    shape = ways.get(behaviour.replace("_", ""))
    if shape is None:
        raise ValueError(f"unknown split behaviour {behaviour!r}")
    return F.filter(F.split(F.regexp_replace(text, pattern, shape), mark), lambda p: p != "")


def pre_tokenized(text: Column, config: dict | None) -> Column:
    """Array of pieces; without a pre-tokenizer, what lies between white space."""
    steps = _steps(config, "pretokenizers") or [{"type": "WhitespaceSplit"}]
    pieces = _pieces(text, steps[0])
    cutter = lambda step: lambda piece: _pieces(piece, step)
    for step in steps[1:]:
        pieces = F.flatten(F.transform(pieces, cutter(step)))
    return pieces


def bpe(vocab: dict[str, int], merges: list, unknown: str | None = None, prefix: str = "", suffix: str = "") -> encoders.Encoder:
    """Ranked merges of characters; ones not in the vocabulary are unknown, or dropped where nothing stands for those."""
    pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges]
    rank = {pair: i for i, pair in enumerate(pairs)}

    def encode(word: str) -> list[str]:
        parts = [(prefix if i else "") + c + (suffix if i + 1 == len(word) else "") for i, c in enumerate(word)]
        parts = [p if p in vocab else unknown for p in parts if p in vocab or unknown is not None]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: rank.get(p, math.inf))
            if best not in rank:
                break
            out, i = [], 0
            while i < len(parts):
                hit = tuple(parts[i : i + 2]) == best
                out.append(parts[i] + parts[i + 1].removeprefix(prefix) if hit else parts[i])
                i += 2 if hit else 1
            parts = out
        return parts

    return encode


def model(config: dict) -> encoders.Encoder:
    kind, vocab, unknown = config["type"], config["vocab"], config.get("unk_token")
    names = [v[0] for v in vocab] if isinstance(vocab, list) else list(vocab)
    if kind in GREEDY:
        return encoders.wordpiece(names, unknown or "[UNK]", config.get("continuing_subword_prefix", "##"), config.get("max_input_chars_per_word", encoders.LONGEST_WORD))
    if kind in VITERBI:
        rare = config.get("unk_id")
        return encoders.unigram({v[0]: v[1] for i, v in enumerate(vocab) if i != rare}, names[rare] if rare is not None else "<unk>")
    if kind in MERGING:
        return bpe({n: i for i, n in enumerate(names)}, config["merges"], unknown, config.get("continuing_subword_prefix") or "", config.get("end_of_word_suffix") or "")
    if kind == "WordLevel":
        return encoders.word_level(names, unknown or "<unk>")
    if kind in SUBSTRINGS:
        return encoders.longest_substring(names, SUBSTRINGS[kind])
    if kind in SUFFIXES:
        return encoders.longest_suffix(names, SUFFIXES[kind])
    raise ValueError(f"unknown model {kind!r}")


def dictionary(docs: DataFrame, config: dict, *by: str) -> DataFrame:
    """(by, pretoken, n): distinct pieces of the texts, normalised and cut as configured."""
    text = normalised(F.col("text"), config.get("normalizer"))
    cut = docs.where(F.col("text").isNotNull()).select(*by, text.alias("_text"))
    rows = cut.select(*by, F.explode(pre_tokenized(F.col("_text"), config.get("pre_tokenizer"))).alias("pretoken"))
    return rows.groupBy(*by, "pretoken").agg(F.count(F.lit(1)).alias("n"))


def encode_dictionary(words: DataFrame, config: dict) -> DataFrame:
    """The rows of a dictionary with ``tokens``; the model runs once for each distinct piece."""
    known = encoders.encode_words(words.select("pretoken").distinct(), model(config["model"]))
    return words.join(known, "pretoken")


def tokenize(docs: DataFrame, config: dict) -> DataFrame:
    """(doc_id, tokens) of every document that has a text."""
    text = normalised(F.col("text"), config.get("normalizer"))
    cut = docs.where(F.col("text").isNotNull()).select("doc_id", text.alias("_text"))
    rows = cut.select("doc_id", F.posexplode_outer(pre_tokenized(F.col("_text"), config.get("pre_tokenizer"))).alias("at", "pretoken"))
    known = encoders.encode_words(rows.where(F.col("pretoken").isNotNull()).select("pretoken").distinct(), model(config["model"]))
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce("at", F.lit(0)).alias("at"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))))
    out = rows.join(known, "pretoken", "left").groupBy("doc_id").agg(F.flatten(F.transform(listed, lambda x: x["tokens"])).alias("tokens"))
    if config["model"]["type"] == REMARKED:
        out = out.withColumn("tokens", F.transform("tokens", lambda t, i: F.when(i > 0, F.concat(F.lit("##"), t)).otherwise(t)))
    return out

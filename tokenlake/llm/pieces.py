r"""SentencePiece encoding and decoding over a relational lattice.

A text becomes words that no piece crosses: a run of blanks with what follows it up to the next blank, and each
character that no longer piece holds by itself. Every word is encoded by a lattice, the piece table joined to all of
its substrings of bounded length, and a fold over that lattice. The public library encodes nothing.

The fold depends on the model. Unigram models take the Viterbi path of the highest score. A BPE model's scores are
merge ranks, and Viterbi over them does not give the model's encoding; there, the fold merges the neighbouring pair
whose joint edge has the best rank (of equals the leftmost) until none is left, which is the model's encoding.
Characters without an edge become byte pieces (the unknown piece where the model has none).

The ``DICTIONARY`` most frequent words of the whole corpus (of at most ``WORD_CHARS`` characters) have their lattice
in relations: substrings are exploded, joined to the piece table on equality and grouped into one row of edges a word;
a Spark higher-order ``aggregate`` folds it. That dictionary, bounded by its parameter, is broadcast.

Documents are coded in Arrow batches, by array operations on all words of a batch: words of the dictionary by lookup;
each other distinct word of the batch, of any length, once by the same lattice and the same fold over arrays. There,
substrings meet the piece table by hash and are compared character by character; words of more than ``LONG_WORD``
characters keep their joints in a heap, so that time grows with n log n. Texts are not shuffled, only word counts are.

Defined cases: a null text has null ids and decodes to null; the empty text has no ids; U+2581 is the model's blank
and decodes as a blank; invalid byte sequences decode to U+FFFD; repeated rows, empty tables and extra columns pass;
an output column that exists already is refused.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.llm import textbuf
from tokenlake.llm.common import forget, materialise

DICTIONARY = 1 << 17
WORD_CHARS = 24
BLANK = "▁"
UNKNOWN_PENALTY = 10.0
#: The dictionary is small in bytes and costly in work, so its tasks are not counted by bytes.
LATTICE_TASKS = 48
#: Characters whose lattice an Arrow batch holds at a time, and how long a word is that folds by itself.
LATTICE_CHARS = 1 << 17
LONG_WORD = 64


class Model(NamedTuple):
    proto: bytes
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    lookup: tuple[bool, ...]
    byte_ids: tuple[int, ...]
    unknown: int
    unigram: bool
    longest: int
    alone: str


def load(path: str) -> Model:
    """A model file, on the driver; ``proto`` is the model without its dummy prefix, as words bring their own blank."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    return from_proto(proto)


def from_proto(proto) -> Model:
    kind = type(proto).SentencePiece
    lookup = tuple(p.type in (kind.NORMAL, kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces)
    pieces = tuple(p.piece for p in proto.pieces)
    normal = [p for p, used in zip(pieces, lookup, strict=True) if used]
    if any(BLANK in p.lstrip(BLANK) for p in normal):
        raise ValueError("a piece crosses the start of a word")
    if proto.normalizer_spec.remove_extra_whitespaces or proto.normalizer_spec.precompiled_charsmap or not proto.normalizer_spec.add_dummy_prefix:
        raise ValueError("only the identity normaliser with a dummy prefix is supported")
    bytes_at = {p: i for i, p in enumerate(pieces) if proto.pieces[i].type == kind.BYTE}
    unknown = next((i for i, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN), 0)
    held = {c for p in normal if len(p) > 1 for c in p}
    alone = "".join(chr(c) for c in range(128) if chr(c) not in held and chr(c) != " ")
    proto.normalizer_spec.add_dummy_prefix = False
    byte_ids = tuple(bytes_at[f"<0x{b:02X}>"] for b in range(256)) if len(bytes_at) == 256 else ()
    unigram = proto.trainer_spec.model_type == type(proto.trainer_spec).UNIGRAM
    return Model(proto.SerializeToString(), pieces, tuple(p.score for p in proto.pieces), lookup, byte_ids, unknown, unigram, max(map(len, normal)), alone)


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, id, score); a vocabulary, bounded by the model."""
    rows = [(p, i, model.scores[i]) for i, p in enumerate(model.pieces) if model.lookup[i]]
    arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.float64()))]
    return spark.createDataFrame(pa.table(arrays, ["piece", "id", "score"]))


def split_words(column: pa.Array, alone: str) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, each behind its dummy prefix (none for the empty text and for null), and where rows end.

    The words of a text are all of its bytes, so they are one buffer with the words' starts as offsets.
    """
    texts = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), BLANK, " ")
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    data, ends = textbuf.utf8(pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(space, texts, none)))
    data, ends = data[ends[0] : ends[-1]], ends - ends[0]
    kinds = np.full(256, 2, np.uint8)
    kinds[32] = 0
    kinds[[ord(c) for c in alone]] = 1
    kind = kinds[data]
    starts = kind == 1
    starts[1:] |= ((kind[1:] == 0) & (kind[:-1] != 0)) | ((kind[1:] == 2) & (kind[:-1] == 1))
    starts[ends[:-1][np.diff(ends) > 0]] = True
    places = np.flatnonzero(starts)
    offsets = np.append(places, len(data)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    return words, np.searchsorted(places, ends)


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, n, edges): all pieces inside each distinct word, as (start, stop, id, score)."""
    words = words.select("word").distinct().repartition(LATTICE_TASKS, "word").withColumn("n", F.length("word"))
    starts = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    spans = starts.select("word", "n", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + longest, F.col("n")))).alias("stop"))
    named = spans.withColumn("piece", F.translate(F.substr("word", F.col("start") + 1, F.col("stop") - F.col("start")), " ", BLANK))
    single = F.col("stop") == F.col("start") + 1
    edges = named.join(F.broadcast(pieces), "piece", "left").where(F.col("id").isNotNull() | single)
    return edges.groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("start", "stop", F.coalesce("id", F.lit(-1)).alias("id"), "score"))).alias("edges"))


def fold_viterbi(df: DataFrame, unknown_score: float) -> DataFrame:
    """Add ``path``: (start, stop, id) of the best-scoring path; of equals the one whose last piece is longer."""
    edges = F.transform("edges", lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["id"].alias("id"), F.coalesce(e["score"], F.lit(unknown_score)).alias("score")))
    kind = "array<struct<score:double,back:int,path:array<struct<start:int,stop:int,id:int>>>>"
    zero = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"), F.array().cast("array<struct<start:int,stop:int,id:int>>").alias("path"))).cast(kind)

    def step(best: Column, stop: Column) -> Column:
        def reach(e: Column) -> Column:
            before = F.get(best, e["start"])
            here = F.array(F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["id"].alias("id")))
            return F.struct((before["score"] + e["score"]).alias("score"), (-e["start"]).alias("back"), F.concat(before["path"], here).alias("path"))

        return F.concat(best, F.array(F.array_max(F.transform(F.filter("_edges", lambda e: e["stop"] == stop), reach))).cast(kind))

    df = df.withColumn("_edges", edges)
    return df.withColumn("path", F.aggregate(F.sequence(F.lit(1), F.col("n")), zero, step, lambda best: F.get(best, F.col("n"))["path"])).drop("_edges")


def fold_merges(df: DataFrame) -> DataFrame:
    """Add ``path``: (start, stop, id) after merging neighbours by the rank of their joint edge."""
    at = lambda a, b: a * 4096 + b
    known = F.filter("edges", lambda e: e["id"] >= 0)
    df = df.withColumn("_by", F.map_from_entries(F.transform(known, lambda e: F.struct(at(e["start"], e["stop"]), F.struct(e["score"].alias("score"), e["id"].alias("id"))))))

    def step(bounds: Column, _: Column) -> Column:
        def joint(i: Column) -> Column:
            left = F.get(bounds, i - 1)
            edge = F.try_element_at("_by", at(left, F.get(bounds, i + 1)))
            return F.struct(edge["score"].alias("score"), (-left).alias("left"), F.get(bounds, i).alias("middle"))

        joints = F.filter(F.transform(F.sequence(F.lit(1), F.size(bounds) - 2), joint), lambda c: c["score"].isNotNull())
        best = F.array_max(joints)["middle"]
        return F.when(F.size(bounds) <= 2, bounds).otherwise(F.when(best.isNull(), bounds).otherwise(F.filter(bounds, lambda b: b != best)))

    bounds = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.sequence(F.lit(0), F.col("n")), step)
    df = df.withColumn("_bounds", bounds)
    edge = lambda i: F.struct(F.get("_bounds", i).alias("start"), F.get("_bounds", i + 1).alias("stop"), F.coalesce(F.try_element_at("_by", at(F.get("_bounds", i), F.get("_bounds", i + 1)))["id"], F.lit(-1)).alias("id"))
    return df.withColumn("path", F.transform(F.sequence(F.lit(0), F.size("_bounds") - 2), edge)).drop("_by", "_bounds")


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """(word, ids) of every distinct, non-empty word, by the lattice."""
    spark = words.sparkSession
    df = lattice(words.where(F.length("word") > 0), piece_table(spark, model), model.longest)
    scores = [s for s, used in zip(model.scores, model.lookup, strict=True) if used]
    df = fold_viterbi(df, min(scores) - UNKNOWN_PENALTY) if model.unigram else fold_merges(df)

    def ids(p: Column) -> Column:
        if not model.byte_ids:
            return F.array(F.when(p["id"] >= 0, p["id"]).otherwise(model.unknown))
        raw = F.hex(F.encode(F.translate(F.substr("word", p["start"] + 1, p["stop"] - p["start"]), " ", BLANK), "utf-8"))
        table = F.array(*map(F.lit, model.byte_ids))
        of_bytes = F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda i: F.get(table, F.conv(F.substr(raw, i, F.lit(2)), 16, 10).cast("int")))
        return F.when(p["id"] >= 0, F.array(p["id"])).otherwise(of_bytes)

    return df.select("word", F.flatten(F.transform("path", ids)).alias("ids"))


def frequent_words(docs: DataFrame, model: Model, most: int = DICTIONARY) -> DataFrame:
    """(word, n): the most frequent words of all texts, all down to some count, and at most ``most`` in number.

    The least count comes from a histogram of counts in fine logarithmic steps, a few thousand rows at any size; no
    task sorts or gathers candidates.
    """
    alone = model.alone

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = split_words(batch.column("text"), alone)[0].dictionary_encode()
            words, n = coded.dictionary, np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            short = pc.less_equal(pc.utf8_length(words), WORD_CHARS)
            yield pa.record_batch({"word": words.filter(short).cast(pa.string()), "n": pa.array(n).filter(short)})

    words = docs.select("text").where(F.length("text") > 0).mapInArrow(count, "word string, n long")
    counted = materialise(words.groupBy("word").agg(F.sum("n").alias("n")), "word_counts")
    steps = counted.groupBy(F.floor(F.log2("n") * 64).alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    held, least = 0, None
    for row in sorted(steps, key=lambda r: -r["step"]):
        held += row["words"]
        if held > most:
            break
        least = row["least"]
    found = materialise(counted.where(F.col("n") >= least) if least is not None else counted.limit(0), "frequent_words")
    forget(counted)
    return found


class Dictionary(NamedTuple):
    """Words whose ids are known; word i has flat[starts[i] : starts[i] + sizes[i]]."""

    words: pa.Array
    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


def dictionary(docs: DataFrame, model: Model, most: int = DICTIONARY) -> Dictionary:
    """The most frequent words, encoded by the lattice; at most ``most``, so it is small enough to broadcast."""
    counted = frequent_words(docs, model, most)
    known = encode_words(counted, model).toArrow().combine_chunks()
    forget(counted)
    lists = known.column("ids").combine_chunks() if known.num_rows else pa.array([], pa.list_(pa.int32()))
    words = known.column("word").combine_chunks().cast(pa.large_string()) if known.num_rows else pa.array([], pa.large_string())
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return Dictionary(words, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum(sizes) - sizes, sizes)


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """values[starts[i] : starts[i] + sizes[i]] for all i, joined."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(ends[-1], values.dtype)
    for at in range(0, len(sizes), block):
        part = sizes[at : at + block]
        low, high = ends[at], ends[at + len(part)]
        out[low:high] = values[np.repeat(starts[at : at + block] - ends[at : at + len(part)] + low, part) + np.arange(high - low)]
    return out


class Lookup(NamedTuple):
    """The piece table by length: sorted hashes of the pieces of each length, their characters and ids."""

    multiplier: np.uint64
    seen: np.ndarray
    tables: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]
    rank: np.ndarray
    score: np.ndarray


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _hashes(points: np.ndarray, longest: int, multiplier: np.uint64) -> Iterator[np.ndarray]:
    """For each length from 1, the hash of the characters from each place on."""
    values = points.astype(np.uint64)
    hashes = values
    for length in range(1, longest + 1):
        yield hashes
        if length < longest:
            hashes = hashes[:-1] * multiplier + values[length:]


def _lookup(model: Model) -> Lookup:
    of_length = [[i for i, p in enumerate(model.pieces) if model.lookup[i] and len(p) == n] for n in range(1, model.longest + 1)]
    for multiplier in (np.uint64(0x9E3779B97F4A7C15 + 2 * k) for k in range(1000)):
        tables, seen = [], np.zeros(1 << 20, bool)
        for n, ids in enumerate(of_length, 1):
            points = _points("".join(model.pieces[i] for i in ids)).reshape(-1, n)
            hashes = np.zeros(len(ids), np.uint64)
            for k in range(n):
                hashes = hashes * multiplier + points[:, k]
            order = np.argsort(hashes)
            tables.append((hashes[order], points[order], np.array(ids, np.int32)[order]))
            seen[hashes >> np.uint64(44)] = True
        if all(np.all(t[0][1:] != t[0][:-1]) for t in tables):
            break
    else:
        raise ValueError("pieces share hashes, or a piece is there twice")
    scores = np.array(model.scores)
    rank = np.append(np.unique(scores, return_inverse=True)[1], -1)  # the last is that of id -1, no piece
    return Lookup(multiplier, seen, tuple(tables), rank, np.append(scores, min(scores[i] for ids in of_length for i in ids) - UNKNOWN_PENALTY))


def edges_of(points: np.ndarray, room: np.ndarray, lookup: Lookup) -> np.ndarray:
    """The lattice of many words that stand in one array: [length - 1, place] is the piece there, -1 for none.

    room: how many characters of its word are left at each place. Equal hashes are compared character by character.
    """
    edges = np.full((len(lookup.tables), len(points)), -1, np.int32)
    for n, (hashes, table) in enumerate(zip(_hashes(points, len(lookup.tables), lookup.multiplier), lookup.tables, strict=True), 1):
        known, chars, ids = table
        at = np.flatnonzero(lookup.seen[hashes >> np.uint64(44)] & (room[: len(hashes)] >= n))
        if not len(known) or not len(at):
            continue
        row = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
        equal = known[row] == hashes[at]
        at, row = at[equal], row[equal]
        for k in range(n):
            equal = points[at + k] == chars[row, k]
            if not equal.all():
                at, row = at[equal], row[equal]
        edges[n - 1, at] = ids[row]
    return edges


def fold_merges_of(edges: np.ndarray, sizes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where pieces start, by ``fold_merges`` for all words at once: in each round, each word merges its best neighbours."""
    longest, n = edges.shape
    starts = np.ones(n, bool)
    at = np.arange(n)
    stop, word = at + 1, np.repeat(np.arange(len(sizes)), sizes)
    while len(at):
        same = word[1:] == word[:-1]
        size = stop[1:] - at[:-1]
        joint = rank[np.where(same & (size <= longest), edges[np.minimum(size, longest) - 1, at[:-1]], -1)]
        many = len(at)
        key = np.append(np.where(joint >= 0, joint * many + np.arange(many - 1, 0, -1), -1), -1)
        first = np.flatnonzero(np.append(True, ~same))
        best = np.maximum.reduceat(key, first)
        more = best >= 0
        left = many - 1 - best[more] % many
        starts[at[left + 1]] = False
        stop[left] = stop[left + 1]
        keep = np.repeat(more, np.diff(np.append(first, many)))
        keep[left + 1] = False
        at, stop, word = at[keep], stop[keep], word[keep]
    return starts


def fold_merges_long(edges: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """``fold_merges`` for one long word, whose joints wait in a heap: the best first, of equals the leftmost."""
    longest, n = edges.shape
    stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
    starts = np.ones(n, bool)

    def joint(left: int) -> tuple | None:
        if left < 0 or stop[left] >= n or (end := stop[stop[left]]) - left > longest:
            return None
        best = int(rank[edges[end - left - 1, left]])
        return (-best, left, stop[left], end) if best >= 0 else None

    heap = [j for j in map(joint, range(n)) if j]
    heapq.heapify(heap)
    while heap:
        _, left, middle, end = heapq.heappop(heap)
        if not starts[left] or not starts[middle] or stop[left] != middle or stop[middle] != end:
            continue
        starts[middle] = False
        stop[left] = end
        if end < n:
            before[end] = left
        for changed in (joint(before[left]), joint(left)):
            if changed:
                heapq.heappush(heap, changed)
    return starts


def fold_viterbi_of(edges: np.ndarray, sizes: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Where pieces start, by ``fold_viterbi`` for all words at once, one end after the other."""
    longest, n = edges.shape
    first = np.cumsum(sizes) - sizes
    best, back = np.zeros(n + 1), np.zeros(n + 1, np.int64)  # of the path up to and with each place
    for end in range(1, int(sizes.max(initial=0)) + 1):
        word = first[sizes >= end]
        last = word + end - 1
        top, size = np.full(len(word), -np.inf), np.zeros(len(word), np.int64)
        for length in range(min(longest, end), 0, -1):
            at = word + end - length
            piece = edges[length - 1, at]
            path = (best[at - 1] if length < end else 0.0) + score[piece]
            better = ((piece >= 0) | (length == 1)) & (path > top)
            top, size = np.where(better, path, top), np.where(better, length, size)
        best[last], back[last] = top, size
    starts = np.zeros(n, bool)
    end = first + sizes
    while len(end):
        end = end - back[end - 1]
        starts[end] = True
        more = end > first
        first, end = first[more], end[more]
    return starts


def _lattice_ids(words: pa.Array, model: Model, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many each word has) of non-empty words of any length, by the lattice."""
    lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
    found, counts, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    bounds = np.cumsum(lengths)
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] - lengths[at] + LATTICE_CHARS, "right")))
        text = "".join(words.slice(at, end - at).to_pylist()).replace(" ", BLANK)
        points, sizes = _points(text), lengths[at:end]
        offset = np.cumsum(sizes) - sizes
        edges = edges_of(points, np.repeat(offset + sizes, sizes) - np.arange(len(points)), lookup)
        if model.unigram:
            starts = fold_viterbi_of(edges, sizes, lookup.score)
        else:
            long = sizes > LONG_WORD
            short = np.repeat(~long, sizes)
            starts = np.ones(len(points), bool)
            starts[short] = fold_merges_of(edges[:, short] if long.any() else edges, sizes[~long], lookup.rank)
            for k in np.flatnonzero(long):
                of = slice(offset[k], offset[k] + sizes[k])
                starts[of] = fold_merges_long(edges[:, of], lookup.rank)
        places = np.flatnonzero(starts)
        ids = edges[np.diff(np.append(places, len(points))) - 1, places]
        n = np.ones(len(ids), np.int64)
        if model.byte_ids and (ids < 0).any():
            bare = np.flatnonzero(ids < 0)
            raw = [text[p].encode() for p in places[bare].tolist()]
            n[bare] = [len(r) for r in raw]
            ids = np.repeat(ids, n)
            ids[ids < 0] = np.array(model.byte_ids, np.int32)[np.frombuffer(b"".join(raw), np.uint8)]
        ids[ids < 0] = model.unknown
        found.append(ids)
        counts.append(np.add.reduceat(n, np.searchsorted(places, offset)))
        at = end
    return np.concatenate(found), np.concatenate(counts)


def _encoder(model: Model, known: Dictionary) -> Callable:
    """A function from a string array to (ids, where rows end in them)."""
    lookup = _lookup(model)

    def encoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, row_ends = split_words(column, model.alone)
        coded = words.dictionary_encode()
        distinct, which = coded.dictionary, coded.indices.to_numpy()
        place = pc.index_in(distinct, value_set=known.words).fill_null(-1).to_numpy() if len(known.words) else np.full(len(distinct), -1)
        others = np.flatnonzero(place < 0)
        fresh, counts = _lattice_ids(distinct.take(pa.array(others)), model, lookup)
        sizes, starts = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        found = place >= 0
        sizes[found], starts[found] = known.sizes[place[found]], known.starts[place[found]]
        sizes[others] = counts
        starts[others] = len(known.flat) + np.cumsum(counts) - counts
        flat = np.concatenate([known.flat, fresh])
        ids = _gather(flat, starts[which], sizes[which])
        return ids, np.concatenate([[0], np.cumsum(sizes[which])])[row_ends]

    return encoded


def _surfaces(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pieces, joined; where each starts, and its size."""
    surface = [p.replace(BLANK, " ").encode() if used else b"" for p, used in zip(model.pieces, model.lookup, strict=True)]
    for b, i in enumerate(model.byte_ids):
        surface[i] = bytes([b])
    surface[model.unknown] = surface[model.unknown] or " \u2047 ".encode()
    sizes = np.fromiter(map(len, surface), np.int64, len(surface))
    return np.frombuffer(b"".join(surface), np.uint8), np.cumsum(sizes) - sizes, sizes


def _decoded(ids: np.ndarray, ends: np.ndarray, valid: np.ndarray, surfaces: tuple) -> pa.Array:
    """The texts of rows of ids: their pieces' bytes, without the blank of the dummy prefix."""
    values, starts, sizes = surfaces
    starts, sizes = starts[ids], sizes[ids]
    first = ends[:-1][np.diff(ends) > 0]  # of each row that has one
    blank = first[(sizes[first] > 0) & (values[np.minimum(starts[first], len(values) - 1)] == 32)]
    starts[blank] += 1
    sizes[blank] -= 1
    raw = _gather(values, starts, sizes).tobytes()
    at = np.concatenate([[0], np.cumsum(sizes)])[ends]
    mask = None if valid.all() else pa.array(~valid)
    try:
        raw.decode()
        inner = at[1:-1][at[1:-1] < len(raw)]
        fine = not len(inner) or not np.any((np.frombuffer(raw, np.uint8)[inner] & 0xC0) == 0x80)
    except UnicodeDecodeError:
        fine = False
    if fine:
        bits = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes()) if mask is not None else None
        return pa.LargeStringArray.from_buffers(len(valid), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw), bits)
    texts = [raw[a:b].decode("utf-8", "replace") if v else None for a, b, v in zip(at, at[1:], valid, strict=False)]
    return pa.array(texts, pa.large_string())


def _lists(ids: np.ndarray, ends: np.ndarray, valid: np.ndarray) -> pa.Array:
    mask = None if valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=mask)


def _valid(column: pa.Array) -> np.ndarray:
    return column.is_valid().to_numpy(zero_copy_only=False)


def _new(df: DataFrame, *names: str) -> None:
    taken = [n for n in names if n in df.columns]
    if taken:
        raise ValueError(f"the table has a column {taken[0]} already")


def encode(docs: DataFrame, model: Model, most: int = DICTIONARY, ids: str = "ids") -> DataFrame:
    """The input's columns, and the pieces of its ``text`` as ``ids``."""
    _new(docs, ids)
    shared = docs.sparkSession.sparkContext.broadcast((model, dictionary(docs, model, most)))

    @F.arrow_udf("array<int>")
    def encoded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(*shared.value)
        for column in texts:
            yield _lists(*encoder(column), _valid(column))

    return docs.withColumn(ids, encoded("text"))


def decode(df: DataFrame, model: Model, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The input's columns, and the text of its ``ids`` as ``decoded``."""
    _new(df, decoded)
    shared = df.sparkSession.sparkContext.broadcast(_surfaces(model))

    @F.arrow_udf("string")
    def surfaces(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in lists:
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield _decoded(column.flatten().to_numpy(zero_copy_only=False), ends, _valid(column), shared.value).cast(pa.string())

    return df.withColumn(decoded, surfaces(ids))


def round_trip(docs: DataFrame, model: Model, most: int = DICTIONARY, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``decode(encode(docs))`` in one pass: the input's columns, ``ids``, and the text that these ids decode to."""
    _new(docs, ids, decoded)
    shared = docs.sparkSession.sparkContext.broadcast((model, dictionary(docs, model, most)))

    @F.arrow_udf(f"struct<{ids}: array<int>, {decoded}: string>")
    def coded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, surfaces = _encoder(*shared.value), _surfaces(shared.value[0])
        for column in texts:
            (found, ends), valid = encoder(column), _valid(column)
            yield pa.StructArray.from_arrays([_lists(found, ends, valid), _decoded(found, ends, valid, surfaces).cast(pa.string())], [ids, decoded])

    return docs.withColumn("_coded", coded("text")).select(*docs.columns, f"_coded.{ids}", f"_coded.{decoded}")

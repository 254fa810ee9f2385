"""SimHash near-duplicates: fingerprints, a pigeonring candidate filter, components.

Fingerprint: A-Z lower-cased, words are runs without white space (blank, tab to carriage return), shingles of
``SHINGLE`` words with repeats, joined by blanks (a shorter text is one shingle; no word: fingerprint 0). A bit is 1
if more than half of the shingles' XXH64 (UTF-8, seed 42) have it.

Links: fingerprints at ``RADIUS`` or fewer differing bits. Only distinct fingerprints are compared, so copies cost
nothing. Pigeonring filter: the 64 bits are a ring of ``SEGMENTS`` segments with a budget of RADIUS / SEGMENTS bits
each. If two fingerprints link, some segment starts a chain in which the first l consecutive segments differ in at
most l * RADIUS / SEGMENTS bits together, for every l. Chains of fewer than SEGMENTS / RADIUS segments have a budget
below one bit: those segments must be equal, and they are the join key. Longer chains prune candidates before the
full Hamming distance is taken.

A key with more than ``BUCKET`` fingerprints is not joined with itself. Its fingerprints go another, exact way, in
rows that grow with their number and not with its square: each is listed under itself and its 64 neighbours at one
bit; two fingerprints share a listing just if they differ in two bits or fewer.

Components: alternating large-star and small-star rounds over the links, each round written to the shared folder.

Defined cases: null and empty texts have fingerprint 0 and link like any other; repeated rows each get a row; a null
doc_id counts for no component id (a component of null ids only has a null id); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenlake.llm import textbuf
from tokenlake.llm.common import forget, join_hot, materialise

SHINGLE = 3
SEED = 42
RADIUS = 2
SEGMENTS = 8
BUCKET = 64
EDGES_A_TASK = 200_000

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprint(text: bytes) -> int:
    """The fingerprint of one text, as an unsigned number."""
    return fold(shingle_hashes(text))


def fold(blocks: Iterable[np.ndarray]) -> int:
    """The fingerprint of shingle hashes that come in blocks."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def shingle_hashes(text: bytes, size: int = SHINGLE, block: int = 1 << 16) -> Iterator[np.ndarray]:
    words = text.translate(_LOWER_BYTES).split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= size:
        yield np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-size] + 1]).tolist()
    stops = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), block):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + block], stops[at : at + block], strict=True)], "<u8")


#: Besides lower case, 0x1C to 0x1F stay what they are: bytes.split() takes the six ASCII blanks alone.
_LOWER_BYTES = _LOWER.tobytes()


@F.arrow_udf(T.LongType())
def _fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        data, offsets = textbuf.utf8(column)
        raw = memoryview(data)
        out = np.array([fingerprint(bytes(raw[offsets[i] : offsets[i + 1]])) for i in range(len(column))], np.uint64)
        yield pa.array(out.view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The input's columns, and ``fp``, the fingerprint as a signed 64-bit number."""
    return docs.withColumn("fp", _fingerprints("text"))


def _segment_bounds(segments: int) -> list[tuple[int, int]]:
    return [(i * 64 // segments, (i + 1) * 64 // segments) for i in range(segments)]


def _chain(segments: int, start: int, length: int) -> int:
    """Bit mask of ``length`` consecutive segments on the ring."""
    mask = 0
    for i in range(length):
        low, high = _segment_bounds(segments)[(start + i) % segments]
        mask |= ((1 << (high - low)) - 1) << low
    return mask - (1 << 64) if mask >> 63 else mask


def _spread(fps: DataFrame, segments: int, radius: int) -> DataFrame:
    """(fp, start, chain): a row for each start of a chain of segments without any budget."""
    free = max(1, -(-segments // radius) - 1)
    chains = F.array(*(F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(_chain(segments, i, free))).alias("chain")) for i in range(segments)))
    return fps.select("fp", F.inline(chains))


def links(fps: DataFrame, segments: int = SEGMENTS, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a <> b: links that connect just what all pairs of distinct ``fps`` within ``radius`` bits connect.

    The way for crowded keys is exact for a radius of 2, the only one it takes.
    """
    if radius != 2:
        raise ValueError("the listing of one-bit neighbours is exact for a radius of 2 only")
    keys = materialise(_spread(fps, segments, radius), "chains")
    crowded = keys.groupBy("start", "chain").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("start", "chain")
    crowded = materialise(crowded, "crowded")
    open_keys = keys.join(crowded, ["start", "chain"], "left_anti")
    a, b = (open_keys.select("start", "chain", F.col("fp").alias(x)) for x in ("a", "b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    pairs = a.join(b, ["start", "chain"]).where(F.col("a") < F.col("b"))
    free = max(1, -(-segments // radius) - 1)
    within = F.lit(True)
    for length in range(free + 1, segments):
        masks = F.array(*(F.lit(_chain(segments, i, length)) for i in range(segments)))
        within = within & (F.bit_count(differ.bitwiseAND(F.get(masks, F.col("start")))) <= length * radius // segments)
    near = pairs.where(within).where(F.bit_count(differ) <= radius).select("a", "b")

    listed = keys.join(crowded, ["start", "chain"], "left_semi").select("fp").distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    listing = listed.select("fp", F.explode(flips).alias("at"))
    heads = listing.groupBy("at").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where(F.col("b") < F.col("top")).select("at", "b")
    star = listing.join(heads, "at").where(F.col("fp") > F.col("b")).select(F.col("fp").alias("a"), "b")
    return near.unionByName(star).distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and summed hashes of an edge list, to see whether a round changed it."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) and the smallest node of its component.

    A node's smallest neighbour is an aggregate that is combined before the shuffle and joined back, so that no task
    needs all edges of a node that has very many. Rounds over few edges are written by few tasks.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while True:
        tasks = 1 + state[0] // EDGES_A_TASK
        old = edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large.coalesce(tasks), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(low, "a").where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(low.select("a", F.col("m").alias("b")).unionByName(down).distinct().coalesce(tasks), "edges")
        before, state = state, _state(edges)
        forget(large), forget(old)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the carried columns, fp, root (a fingerprint) and component_id of every row of ``docs``."""
    marked = fingerprints(docs.select("doc_id", "text", *carried)).select("doc_id", *carried, "fp")
    marked = materialise(marked, "fingerprints")
    firsts = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = components(links(firsts.select("fp")))
    named = firsts.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "rooted")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(ids, "root").select("fp", "root", "component_id")
    copies = marked.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    return join_hot(marked, by_fp, "fp", F.monotonically_increasing_id(), copies).select("doc_id", *carried, "fp", "root", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

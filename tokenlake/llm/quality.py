"""Quality: similarity-weighted votes of labelled neighbours in a latent-semantic space.

Character trigrams (case kept, white space as it is) are hashed to ``BUCKETS`` counts; one term more counts words that
repeat the word before. Counts are damped by log(1 + tf), scaled by inverse document frequency (the repeat term by
``REPEAT_WEIGHT`` more, as it stands alone against thousands of trigrams) and normalised. A truncated SVD over a bounded sample of labelled documents
(``SAMPLE_A_CLASS`` of each class; the parameter is the bound) gives ``RANK`` latent dimensions. The sample's latent
vectors are broadcast (at most 2 * SAMPLE_A_CLASS * RANK floats); for every document, exact cosine products with all
of them are taken in blocks, and the ``NEIGHBOURS`` nearest vote with their similarity, weighted back to the classes'
true shares.

Defined cases: null and empty texts, and texts shorter than three characters, have no direction and score the
weighted share of class 1; so does every text where no labelled rows exist (0). Of equally near neighbours the order
of the sample decides. Repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm import labelled, textbuf
from tokenlake.llm.common import held_out

BITS = 11
BUCKETS = 1 << BITS
TERMS = BUCKETS + 1
REPEAT_WEIGHT = 4.0
SAMPLE_A_CLASS = 2000
RANK = 48
NEIGHBOURS = 15
BLOCK = 512
THRESHOLD = 0.3


def _repeats(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many words of each piece equal the word before."""
    solid = textbuf.FOLDED[points] != 32
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[ends[:-1][ends[:-1] < len(points)]] = solid[ends[:-1][ends[:-1] < len(points)]]
    starts = np.flatnonzero(first)
    if len(starts) < 2:
        return np.zeros(len(ends) - 1, np.int64)
    place = (np.arange(len(points)) - starts[np.maximum(np.cumsum(first) - 1, 0)] + 1).astype(np.uint64)
    mixed = (points.astype(np.uint64) + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)) * solid
    words = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), starts)
    piece = np.searchsorted(ends, starts, "right") - 1
    again = (words[1:] == words[:-1]) & (piece[1:] == piece[:-1])
    return np.bincount(piece[1:][again], minlength=len(ends) - 1)


def _counts(column) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, trigram counts) of a block of rows at a time."""
    for first in range(0, len(column), BLOCK):
        part = column.slice(first, BLOCK)
        out = np.zeros((len(part), TERMS), np.float32)
        for points, ends, rows in textbuf.pieces(part, 2):
            out[rows[0] : rows[-1] + 1, BUCKETS] += _repeats(points, ends)
            for n, bucket in textbuf.ngram_buckets(points, (3,), BITS):
                row = np.repeat(rows, np.diff(ends))[: len(bucket)]
                crossing = np.concatenate([ends[1:] - 1, ends[1:] - 2])
                cell = (row - rows[0]) << BITS | bucket
                cell = np.delete(cell, np.unique(crossing[(crossing >= 0) & (crossing < len(cell))]))
                found = np.bincount(cell, minlength=len(rows) << BITS)
                out[rows[0] : rows[-1] + 1, :BUCKETS] += found.reshape(len(rows), BUCKETS)
        yield first, out


def _scaled(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _axes(x: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration from a fixed start."""
    rank = min(rank, *x.shape)
    basis = np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 16, x.shape[1]))).astype(np.float32)
    for _ in range(6):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, rotate = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ rotate.T)[:, :rank].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    rows, share = labelled.sample(docs, labels, label, SAMPLE_A_CLASS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in _counts(batch.column("text")):
                packed = [x.astype("<f4").tobytes() for x in block]
                yield pa.record_batch({"y": batch.column("y").slice(first, len(block)), "counts": pa.array(packed, pa.binary())})

    got = rows.mapInArrow(count, "y int, counts binary").orderBy(F.xxhash64("counts"), "y").toArrow()
    if not got.num_rows:
        return {"idf": np.ones(TERMS, np.float32), "axes": np.zeros((TERMS, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "y": np.zeros(0, np.float32), "w": np.zeros(0, np.float32), "share": 0.0}
    x = np.stack([np.frombuffer(b, "<f4") for b in got.column("counts").to_pylist()])
    y = got.column("y").to_numpy().astype(np.float32)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    idf[BUCKETS] *= REPEAT_WEIGHT
    x = _scaled(x, idf)
    axes = _axes(x, RANK)
    weight = np.where(y == 1, share.get(1, 0), share.get(0, 0)).astype(np.float32)
    return {"idf": idf, "axes": axes, "vectors": _unit(x @ axes), "y": y, "w": weight, "share": float((weight * y).sum() / weight.sum())}


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's ``k`` largest values; of equal ones at the border the first."""
    border = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
    above, level = near > border, near == border
    picked = above | level & (np.cumsum(level, 1, dtype=np.int32) <= k - above.sum(1, keepdims=True))
    return np.nonzero(picked)[1].reshape(len(near), k)


def vote(latent: np.ndarray, model: dict) -> np.ndarray:
    """Scores of a block of latent unit vectors against all labelled ones."""
    near = latent @ model["vectors"].T
    k = min(NEIGHBOURS, near.shape[1])
    top = nearest(near, k)
    weight = np.maximum(np.take_along_axis(near, top, 1), 0) * model["w"][top]
    total = weight.sum(1)
    return np.where(total > 1e-9, (weight * model["y"][top]).sum(1) / np.maximum(total, 1e-9), model["share"])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """The input's columns, and ``quality_score`` (0 to 1) of its ``text``."""
    if not len(model["vectors"]):
        return docs.withColumn("quality_score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for column in texts:
            out = np.zeros(len(column))
            for first, counts in _counts(column):
                out[first : first + len(counts)] = vote(_unit(_scaled(counts, model["idf"]) @ model["axes"]), model)
            yield pa.array(out)

    return docs.withColumn("quality_score", scored("text"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    narrow = docs.select("doc_id", "text")
    out = score(narrow, fit(narrow, labels, label))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))

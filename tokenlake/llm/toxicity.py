"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training uses a bounded sample of labelled documents (``SAMPLE_A_CLASS`` of each class; the parameter is the bound).
Character n-grams of 3 to 6 code points, folded to lower case with white space as one blank, are hashed to
``2 ** BITS`` buckets. Document frequencies by class are counted in Spark; the ``FEATURES`` buckets whose log-count
ratio is the most significant stay. The design matrix holds each present feature's ratio; logistic regression with a
ridge penalty, weighted back to the classes' true shares, is solved by Newton steps. Scoring reads every whole text.

Defined cases: null and empty texts have no features and score the intercept; without labelled rows of both classes
every score is the share of class 1 (0 if there are no labels); repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm import labelled, textbuf
from tokenlake.llm.common import held_out

SIZES = (3, 4, 5, 6)
BITS = 20
SAMPLE_A_CLASS = 4000
FEATURES = 1024
LEAST_DOCS = 3
LEAST_Z = 3.0
RIDGE = 1.0
THRESHOLD = 0.5


def _present(column, chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) pairs, each once. chosen: only these buckets, as a mask."""
    found = []
    for points, ends, rows in textbuf.pieces(column, max(SIZES) - 1):
        folded = textbuf.FOLDED[points]
        for n, bucket in textbuf.ngram_buckets(folded, SIZES, BITS):
            at = np.arange(len(bucket)) if chosen is None else np.flatnonzero(chosen[bucket])
            piece = np.searchsorted(ends, at, "right") - 1
            inside = at + n <= ends[piece + 1]
            found.append(np.unique(rows[piece[inside]] << BITS | bucket[at[inside]]))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for first in range(0, batch.num_rows, 64):  # every n-gram of these rows is held at once
            part = batch.slice(first, 64)
            y = part.column("y").to_numpy()
            rows, buckets = _present(part.column("text"), None)
            for label in (0, 1):
                counts[label] += np.bincount(buckets[y[rows] == label], minlength=1 << BITS)
    seen = np.flatnonzero(counts.sum(0))
    yield pa.record_batch({"bucket": seen, "n0": counts[0][seen], "n1": counts[1][seen]})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict:
    """Model: ``mask`` of chosen buckets, ``weight`` by bucket, ``bias``."""
    rows, share = labelled.sample(docs, labels, label, SAMPLE_A_CLASS)
    empty = {"buckets": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": 0.0, "constant": 0.0}
    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(size) < 2:
        return empty | {"constant": 1.0 if 1 in size else 0.0}
    counts = rows.mapInArrow(_count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ratio = F.ln((F.col("n1") + 1) / F.lit(size[1] + 2.0)) - F.ln((F.col("n0") + 1) / F.lit(size[0] + 2.0))
    z = F.abs(ratio) / F.sqrt(1 / (F.col("n1") + 1.0) + 1 / (F.col("n0") + 1.0))
    best = counts.where(F.col("n0") + F.col("n1") >= LEAST_DOCS).select("bucket", ratio.alias("ratio"), z.alias("z")).where(F.col("z") >= LEAST_Z)
    best = best.orderBy(F.desc("z"), "bucket").limit(FEATURES).collect()
    buckets = np.array(sorted(r["bucket"] for r in best), np.int64)
    ratios = np.array([r["ratio"] for r in sorted(best, key=lambda r: r["bucket"])])
    mask = np.zeros(1 << BITS, np.uint8)
    mask[buckets] = 1

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, which = _present(batch.column("text"), mask)
            place = np.searchsorted(buckets, which)
            lists = np.split(place, np.searchsorted(found, np.arange(1, batch.num_rows)))
            yield pa.record_batch({"y": batch.column("y"), "f": pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))})

    got = rows.mapInArrow(sparse, "y int, f array<long>").toArrow()
    y = got.column("y").to_numpy().astype(float)
    lengths = np.array([len(x) for x in got.column("f").to_pylist()], np.int64)
    x = np.zeros((len(y), len(buckets) + 1), np.float32)
    flat = got.column("f").combine_chunks().flatten().to_numpy()
    x[np.repeat(np.arange(len(y)), lengths), flat] = ratios[flat]
    x[:, -1] = 1
    w = _logistic(x, y, np.where(y == 1, share[1], share[0]) * len(y) / sum(share[k] * size[k] for k in size))
    return {"buckets": buckets, "weights": w[:-1] * ratios, "bias": float(w[-1]), "constant": None}


def _logistic(x: np.ndarray, y: np.ndarray, row_weight: np.ndarray, steps: int = 12) -> np.ndarray:
    """Ridge-penalised logistic regression; the last column, the intercept, is not penalised."""
    penalty = np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (row_weight * (p - y)) + penalty * w
        curve = (row_weight * np.maximum(p * (1 - p), 1e-4)).astype(np.float32)
        hessian = (x.T @ (x * curve[:, None])).astype(float) + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


def score(docs: DataFrame, model: dict, name: str = "toxicity_score") -> DataFrame:
    """The input's columns, and the score (0 to 1) of its ``text`` as ``name``."""
    if model["constant"] is not None:
        return docs.withColumn(name, F.lit(float(model["constant"])))
    shared = docs.sparkSession.sparkContext.broadcast((model["buckets"], model["weights"], model["bias"]))

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets, weights, bias = shared.value
        mask, by_bucket = np.zeros(1 << BITS, np.uint8), np.zeros(1 << BITS)
        mask[buckets], by_bucket[buckets] = 1, weights
        for column in texts:
            rows, which = _present(column, mask)
            total = bias + np.bincount(rows, by_bucket[which], minlength=len(column))
            yield pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))

    return docs.withColumn(name, scored("text"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    narrow = docs.select("doc_id", "text")
    out = score(narrow, fit(narrow, labels, label))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= THRESHOLD).cast("int").alias("predicted"))

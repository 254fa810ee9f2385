"""Bounded, deterministic samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.common import held_out


def sample(docs: DataFrame, labels: DataFrame, label: str, a_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(text, y) of at most ``a_class`` labelled documents of each class, and the weight each sampled row stands for.

    Held-out documents, null ids and null labels are left out; of several labels of one document the largest counts.
    The sample is the ``a_class`` smallest hashes of doc_id in each class, so it is the same on every run. Its ids
    (bounded by twice ``a_class``) are broadcast; documents are not shuffled.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("y"))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = None
    for y in sorted(totals):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(a_class)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        picked = known
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "y")
    return rows, {y: n / min(n, a_class) for y, n in totals.items()}

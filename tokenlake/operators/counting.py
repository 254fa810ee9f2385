"""Counts over the pre-token dictionary: bytes, adjacent pairs, pair scores, top-k.

All of these work on distinct pre-tokens weighted by their counts, so their cost follows the vocabulary, not the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.functions import text as tx


def byte_unigrams(words: DataFrame, *by: str) -> DataFrame:
    """(by, byte, n) from (by, pretoken, n)."""
    return words.select(*by, F.explode(tx.raw_bytes(F.col("pretoken"))).alias("byte"), "n").groupBy(*by, "byte").agg(F.sum("n").alias("n"))


def adjacent_pairs(words: DataFrame, *by: str) -> DataFrame:
    """(by, left, right, n): adjacent bytes inside pre-tokens, overlapping ones included."""
    raw = tx.raw_bytes(F.col("pretoken"))
    pairs = F.zip_with(F.slice("raw", 1, F.size("raw") - 1), F.slice("raw", 2, F.size("raw") - 1), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    rows = words.select(*by, raw.alias("raw"), "n").where(F.size("raw") > 1).select(*by, F.inline(pairs), "n")
    return rows.groupBy(*by, "left", "right").agg(F.sum("n").alias("n"))


def pair_scores(pairs: DataFrame, unigrams: DataFrame) -> DataFrame:
    """Mutual-information score of each pair: its count over the product of its members' counts. At most 256 unigrams are broadcast."""
    one = lambda side: F.broadcast(unigrams.select(F.col("byte").alias(side), F.col("n").alias(f"n_{side}")))
    joined = pairs.join(one("left"), "left").join(one("right"), "right")
    return joined.select("left", "right", "n", (F.col("n").cast("double") / (F.col("n_left").cast("double") * F.col("n_right").cast("double"))).alias("score"))


def top(df: DataFrame, k: int, count: str, *ties: str) -> DataFrame:
    """The ``k`` largest counts, ties broken by the given columns."""
    return df.orderBy(F.desc(count), *ties).limit(k)

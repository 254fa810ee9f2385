"""Evaluation of segmentations: boundary F1, difference rate, correlations with behavioural data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boundaries(tokens: Column) -> Column:
    """Inner boundary offsets of a segmentation: running lengths without the last."""
    ends = F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda k: F.aggregate(F.slice(tokens, 1, k), F.lit(0), lambda a, t: a + F.length(t)))
    return F.when(F.size(tokens) > 1, ends).otherwise(F.array().cast("array<int>"))


def boundary_counts(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Add tp, fp and fn of predicted boundaries (columns of segmentations)."""
    g, p = boundaries(F.col(gold)), boundaries(F.col(predicted))
    return rows.withColumns({"tp": F.size(F.array_intersect(g, p)), "fp": F.size(F.array_except(p, g)), "fn": F.size(F.array_except(g, p))})


def boundary_f1(rows: DataFrame, by: str) -> DataFrame:
    """(by, f1) from rows with tp, fp and fn: ``tp / (tp + (fp + fn) / 2)``, 0 where there is no boundary."""
    sums = rows.groupBy(by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    below = F.col("tp") + 0.5 * (F.col("fp") + F.col("fn"))
    return sums.select(by, F.when(below > 0, F.col("tp") / below).otherwise(0.0).alias("f1"))


def macro_f1(f1: DataFrame) -> DataFrame:
    return f1.agg(F.avg("f1").alias("macro_f1"))


def difference_rate(rows: DataFrame, one: str, other: str) -> DataFrame:
    """rate: share of rows whose two segmentations differ."""
    return rows.agg(F.avg((~F.col(one).eqNullSafe(F.col(other))).cast("double")).alias("rate"))


def lexical_measures(rows: DataFrame, word: str, n_tokens: Column) -> DataFrame:
    """Add length, num_splits and chunkability of each stimulus."""
    n, size = n_tokens.cast("double"), F.length(word)
    return rows.withColumns({"length": size, "num_splits": n_tokens - 1, "chunkability": F.when(size > 0, 1 - n / size)})


def category_stats(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, mean, std): mean and population deviation, without nulls."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def correlations(rows: DataFrame, by: tuple[str, ...], xs: tuple[str, ...], ys: tuple[str, ...]) -> DataFrame:
    """(by, x_y ...): Pearson's r of each x with each y over rows without nulls in any of them."""
    fine = rows.na.drop(subset=[*xs, *ys])
    return fine.groupBy(*by).agg(*(F.corr(x, y).alias(f"{x}_{y}") for x in xs for y in ys))


def cognitive_score(found: DataFrame, columns: list[str]) -> DataFrame:
    """Add score: the mean of the absolute correlations."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.abs(F.col(c))
    return found.withColumn("score", total / len(columns))


def pearson_p(r: float, n: int) -> float:
    """Two-sided p-value of Pearson's r: Student's t with n - 2 degrees of freedom, by the incomplete beta function."""
    if n < 3 or math.isnan(r):
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    return _regularised_beta((n - 2) / 2, 0.5, 1 - r * r)


def _regularised_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _regularised_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    total, up, down = 1.0, 1.0, 0.0  # modified Lentz evaluation of the continued fraction
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        down = 1 / (1 + term * down or 1e-300)
        up = 1 + term / up or 1e-300
        total *= up * down
        if abs(1 - up * down) < 1e-15:
            break
    return front * (total - 1)

"""Corpus and tokenizer statistics.

Tokenizers are described by (pretoken, n, ids): distinct pre-tokens, their counts and their pieces. Every statistic is
an aggregate over those rows, by language where asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def renyi_efficiency(counts: DataFrame, by: tuple[str, ...] = (), alpha: float = 2.5, n: str = "n") -> DataFrame:
    """(by, renyi_efficiency) of type counts: Renyi entropy of order ``alpha`` over the log of observed types.

    Sum p^alpha = Sum n^alpha / total^alpha, so one pass suffices. With fewer than two types it is null.
    """
    sums = counts.groupBy(*by).agg(F.sum(F.pow(F.col(n).cast("double"), F.lit(alpha))).alias("_s"), F.sum(n).alias("_t"), F.count(F.lit(1)).alias("_v"))
    entropy = (F.log2("_s") - alpha * F.log2("_t")) / (1 - alpha)
    return sums.select(*by, F.when(F.col("_v") > 1, entropy / F.log2("_v")).alias("renyi_efficiency"))


def split_histogram(encoded: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, length, n): words by their number of pieces."""
    return encoded.groupBy(*by, F.size("ids").alias("length")).agg(F.sum("n").alias("n"))


def fertility(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, fertility, proportion_continued, total_split_words, total_words, total_subwords); 0 where there are no words."""
    length, n = F.col("length"), F.col("n")
    sums = hist.groupBy(*by).agg(F.sum(length * n).alias("total_subwords"), F.sum(n).alias("total_words"), F.sum(F.when(length != 1, n).otherwise(0)).alias("total_split_words"))
    share = lambda c: F.when(F.col("total_words") > 0, F.col(c) / F.col("total_words")).otherwise(0.0)
    return sums.select(*by, share("total_subwords").alias("fertility"), share("total_split_words").alias("proportion_continued"), "total_split_words", "total_words", "total_subwords")


def tokenizer_statistics(encoded: DataFrame, name: str, unknown_id: int | None = None, by: tuple[str, ...] = (), languages: list[str] | None = None) -> DataFrame:
    """The statistics row of a tokenizer (by language): fertility and continuation, tokens, unknowns, Renyi efficiency, types.

    With ``languages`` there is a row for each of them, of zeros where there are no words.
    """
    base = fertility(split_histogram(encoded, by), by)
    types = encoded.select(*by, F.explode("ids").alias("id"), "n").groupBy(*by, "id").agg(F.sum("n").alias("n"))
    unknown = F.sum(F.when(F.col("id") == unknown_id, F.col("n")).otherwise(0)) if unknown_id is not None else F.lit(0).cast("long")
    of_types = types.groupBy(*by).agg(F.count(F.lit(1)).alias("unique_tokens"), unknown.alias("num_unk"))
    total_bytes = encoded.groupBy(*by).agg(F.sum(F.octet_length("pretoken") * F.col("n")).alias("total_tokens"))
    renyi = renyi_efficiency(types, by)
    if by:
        out = base.join(of_types, list(by)).join(total_bytes, list(by)).join(renyi, list(by))
    else:
        out = base.crossJoin(of_types).crossJoin(total_bytes).crossJoin(renyi)  # one row each
    if languages is not None:
        every = encoded.sparkSession.createDataFrame([(x,) for x in languages], f"{by[0]} string")
        out = every.join(out, by[0], "left").fillna(0)
    return out.withColumn("tokenizer_name", F.lit(name))


def whitespace_fertility(docs: DataFrame, n_tokens: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, fertility): tokens for each word between white space."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    sums = docs.where(F.col("text").isNotNull()).groupBy(*by).agg(F.sum(n_tokens).alias("t"), F.sum(words).alias("w"))
    return sums.select(*by, F.when(F.col("w") > 0, F.col("t") / F.col("w")).otherwise(0.0).alias("fertility"))


def bits_per_byte(rows: DataFrame, context: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by) mean and population deviation of bits per byte and perplexity, from (loss in nats, num_tokens, num_bytes) a row.

    ``context``: divide by this length, as a fixed evaluation window does, and not by the row's own bytes.
    """
    size = F.lit(float(context)) if context else F.col("num_bytes").cast("double")
    bpb = F.col("loss") / F.log(F.lit(2.0)) * F.col("num_tokens") / size
    scored = rows.select(*by, bpb.alias("bpb"), F.exp("loss").alias("perplexity"))
    return scored.groupBy(*by).agg(*(f(c).alias(f"{c}_{name}") for c in ("bpb", "perplexity") for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))))

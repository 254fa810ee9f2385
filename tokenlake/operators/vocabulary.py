"""Choosing vocabularies from counted tokens, and comparing them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget(final_size: int, proportion: float, base: int) -> float:
    """Entries that spans may take: their share of the final size without the base vocabulary, 0 at least."""
    if not 0 <= proportion <= 1:
        raise ValueError("proportion must lie between 0 and 1")
    return max(0.0, proportion * final_size - base)


def by_frequency(tokens: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent tokens (token, n) not among ``known`` (token); of equals the smaller text."""
    return tokens.join(known.select("token"), "token", "left_anti").orderBy(F.desc("n"), "token").limit(k)


def round_robin(tokens: DataFrame, known: DataFrame, limit: float, languages: list[str]) -> DataFrame:
    """(place, token): languages take turns, each giving its most frequent token not yet taken, until ``limit`` is met.

    A language's own place counts tokens of its own list; a token that several languages have is taken once, at the
    first turn that offers it, and the later turn passes.
    """
    fresh = tokens.where(F.col("lang").isin(languages)).join(known.select("token"), "token", "left_anti")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token"))
    seat = F.array_position(F.array(*map(F.lit, languages)), F.col("lang"))
    k = math.ceil(limit)
    offered = fresh.withColumn("turn", turn).where(F.col("turn") <= k).withColumn("seat", seat)
    first = offered.groupBy("token").agg(F.min(F.struct("turn", "seat")).alias("at"))
    chosen = first.orderBy("at.turn", "at.seat").limit(k)
    return chosen.select((F.row_number().over(Window.orderBy("at.turn", "at.seat")) - 1).alias("place"), "token")


def extend(base: DataFrame, chosen: DataFrame, final_size: int) -> DataFrame:
    """(token, token_id): the base vocabulary and chosen tokens (place, token) behind it, cut at ``final_size``."""
    size = base.count()
    return base.select("token", "token_id").unionByName(chosen.select("token", (F.col("place") + size).cast("int").alias("token_id"))).where(F.col("token_id") < final_size)


def overlap_percent(one: DataFrame, other: DataFrame) -> DataFrame:
    """overlap: percent of the first vocabulary's tokens that the second has."""
    both = one.select("token").intersect(other.select("token")).agg(F.count(F.lit(1)).alias("both"))
    return both.crossJoin(one.agg(F.count(F.lit(1)).alias("size"))).select((F.col("both") / F.col("size") * 100).alias("overlap"))


def length_histogram(vocab: DataFrame, longest: int = 19) -> DataFrame:
    """(length, n) for lengths 1 to ``longest``, zeros included, without the continuation mark."""
    length = F.length(F.regexp_replace("token", "^##", ""))
    found = vocab.groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("n"))
    return vocab.sparkSession.range(1, longest + 1).select(F.col("id").cast("int").alias("length")).join(F.broadcast(found), "length", "left").select("length", F.coalesce("n", F.lit(0)).alias("n"))


def canonical_name(name: Column) -> Column:
    """Display name of a tokenizer: its parts in reading order, sizes in thousands."""
    size = F.regexp_extract(name, r"_(\d+)$", 1)
    base = F.regexp_replace(name, r"_\d+$", "")
    words = F.initcap(F.translate(base, "_-", "  "))
    return F.when(size == "", words).otherwise(F.concat(words, F.lit(" "), F.floor(size.try_cast("int") / 1000).cast("string"), F.lit("k")))


def folders(paths: DataFrame, part: str = "") -> DataFrame:
    """(folder): distinct parent folders of listed files (path), those whose name holds ``part``."""
    return paths.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).where((F.col("folder") != "") & F.col("folder").contains(part)).distinct()


def todo(wanted: DataFrame, done: DataFrame, key: str = "tokenizer_name") -> DataFrame:
    """Wanted rows without results yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.session import ship_package
from tokenlake.sources.io import forget, materialise  # noqa: F401 (shared by the operators)

#: A key is hot if it holds more than one of this many rows, so there are never more hot keys than this.
HOT_SHARE = 1000
#: A hot key's rows are dealt over this many tasks.
SALTS = 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def join_hot(rows: DataFrame, table: DataFrame, key: str, salt: Column, counts: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table`` (few rows a key) on ``key``, however many of the rows one key holds.

    counts: ``key`` and ``n``, how many rows there are of each key. Keys of more than one ``HOT_SHARE``-th of all rows
    (so at most ``HOT_SHARE`` keys, which are broadcast) are dealt over ``SALTS`` tasks by ``salt``, a number from the
    row; their rows of ``table`` are repeated for each. Both sides are sorted and merged at every size: ``table`` grows
    with the input, and a sort can spill.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r[0] for r in counts.where(F.col("n") * HOT_SHARE > total).select(key).collect()] if total > HOT_SHARE else []
    if not hot:
        return rows.join(table.hint("merge"), key, how)
    known = F.col(key).isin(hot)
    rows = rows.withColumn("_salt", F.when(known, F.pmod(salt, F.lit(SALTS))).otherwise(0).cast("int"))
    every = F.when(known, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(table.withColumn("_salt", F.explode(every)).hint("merge"), [key, "_salt"], how).drop("_salt")


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 5 is 0; a null id counts as the empty text, whose crc32 is 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0

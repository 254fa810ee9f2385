"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted hash draws.

At every level each child draws ``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's own
name, and the smallest draw wins. A child's draw depends on nothing but the key, its name and its weight, so a
change of weights moves rows only out of or into subtrees whose weight changed: among untouched siblings the
order of draws stays as it was.

The number of shards grows by opening a region for the new shard: no existing node's weight changes, hence rows
move only into the new region, and law ``key`` holds (doc_id and shard count decide).

Defined cases: a null key hashes as the reserved text ``<null>``; null text has size 1 and the crc32 of no bytes;
repeated rows share a shard and get different slots; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenlake.llm.common import materialise

ROWS_A_BUCKET = 100_000
LEAST_BUCKETS = 64


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def base_tree(n_shards: int = 8) -> list[Leaf]:
    """Two regions of two racks each; the shards are dealt to racks in order."""
    return [Leaf(i * 2 // n_shards, i * 4 // n_shards, i) for i in range(n_shards)]


def grow(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region and rack of its own."""
    top = [max(x) + 1 for x in zip(*(leaf[:3] for leaf in tree), strict=True)]
    return [*tree, Leaf(*top, weight)]


def _pick(key: Column, level: str, weights: dict[int, float]) -> Column:
    """The child with the smallest draw; of equal draws the smaller child."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))

    def draw(child: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}:{child}")), 11)
        return -F.ln((bits.cast("double") + 1.0) / float(2**53 + 1)) / F.lit(float(weight))

    draws = F.array(*(F.struct(draw(c, w).alias("draw"), F.lit(c).alias("child")) for c, w in sorted(weights.items()) if w > 0))
    return F.array_min(draws)["child"]


def _sum_by(tree: Sequence[Leaf], level: str) -> dict[int, float]:
    out: dict[int, float] = {}
    for leaf in tree:
        out[getattr(leaf, level)] = out.get(getattr(leaf, level), 0.0) + leaf.weight
    return out


def descend(df: DataFrame, key: Column, tree: Sequence[Leaf], prefix: str = "") -> DataFrame:
    """Add ``{prefix}region``, ``{prefix}rack`` and ``{prefix}shard``. The tree is cluster topology, small by nature."""
    key = F.coalesce(key.cast("string"), F.lit("<null>"))
    region, rack, shard = (f"{prefix}{x}" for x in ("region", "rack", "shard"))
    df = df.withColumn(region, _pick(key, "region", _sum_by(tree, "region")))
    for above, name, level in ((region, rack, "rack"), (rack, shard, "shard")):
        which, choice = ("region" if level == "rack" else "rack"), None
        for node in sorted(_sum_by(tree, which)):
            inside = _sum_by([x for x in tree if getattr(x, which) == node], level)
            hit = F.col(above) == node
            choice = F.when(hit, _pick(key, level, inside)) if choice is None else choice.when(hit, _pick(key, level, inside))
        df = df.withColumn(name, choice)
    return df


def number_slots(df: DataFrame, group: str, order: Sequence[str], n_rows: int) -> DataFrame:
    """Gapless ``slot`` from 0 within each ``group``, in no task more than a bucket of rows.

    Rows are numbered within hash buckets; a bucket starts where the counts of those before it end.
    """
    n_buckets = max(LEAST_BUCKETS, 2 ** math.ceil(math.log2(max(1, n_rows / ROWS_A_BUCKET))))
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n_buckets)))
    counts = keyed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    numbered = keyed.withColumn("_at", F.row_number().over(inside))
    return numbered.join(starts, [group, "_bucket"]).withColumn("slot", F.col("_start") + F.col("_at") - 1).drop("_bucket", "_at", "_start")


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    tree = base_tree(n_shards)
    placed = descend(narrow, F.col("doc_id"), tree)
    placed = descend(placed, F.col("doc_id"), grow(tree), "grown_").drop("grown_region", "grown_rack")
    placed = materialise(placed, "shards")  # the texts are read once; a few dozen bytes a row go on
    slotted = number_slots(placed, "shard", ["doc_id", "size", "text_crc32"], placed.count())
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")

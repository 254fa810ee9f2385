"""Byte n-gram tables, absolute-discounting scores and entropies.

Tables have one row for each (order, context, byte). The interpolated probability of a byte is
``max(n(c,w) - d, 0) / n(c) + d * T(c) / n(c) * p(w | shorter c)``, ``n(w) / N`` for the empty context; an unseen
context passes to the shorter one. Entropy needs no row for each possible byte: it follows from the seen ones and the
shorter context's entropy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenlake.operators import bytearrays
from tokenlake.sources.io import materialise

DISCOUNT = 0.75
#: Padding symbols; bytes are 0 to 255.
START, STOP = 256, 257
SPACE = 32


def _unpacked(table: DataFrame) -> DataFrame:
    """(order, context, word, n) of (order, key, n)."""
    symbol = lambda i: F.call_function("shiftright", F.col("key"), (F.lit(bytearrays.SYMBOL_BITS) * i).cast("int")).bitwiseAND(F.lit(511)).cast("int")
    places = F.when(F.col("order") > 1, F.sequence(F.col("order") - 1, F.lit(1))).otherwise(F.array().cast("array<int>"))
    return table.select("order", F.transform(places, symbol).alias("context"), symbol(F.lit(0)).alias("word"), "n")


def packed(context: Column, word: Column | None = None) -> Column:
    """A context, with or without the symbol behind it, as one long."""
    symbols = F.transform(context, lambda x: x.cast("long"))
    key = F.aggregate(symbols, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, bytearrays.SYMBOL_BITS).bitwiseOR(x))
    return key if word is None else F.shiftleft(key, bytearrays.SYMBOL_BITS).bitwiseOR(word.cast("long"))


def counts(docs: DataFrame, orders: list[int], pad_to: int | None = None) -> DataFrame:
    """(order, context, word, n), each document between ``pad_to - 1`` start and stop symbols."""
    return _unpacked(bytearrays.gram_counts(docs, orders, START, STOP, (pad_to or max(orders)) - 1))


def merge(*parts: DataFrame) -> DataFrame:
    """Counters added up: keys of all sides stay."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("order", "context", "word").agg(F.sum("n").alias("n"))


def probabilities(table: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """(order, context, word, n, p, gamma, entropy): interpolated probability of every seen n-gram, and its context's
    back-off weight and entropy in bits."""
    orders = sorted(r["order"] for r in table.select("order").distinct().collect())
    done = None
    for k in orders:
        by = Window.partitionBy("context")
        level = table.where(F.col("order") == k).select("order", "context", "word", "n")
        level = level.withColumn("total", F.sum("n").over(by)).withColumn("types", F.count(F.lit(1)).over(by))
        if k == orders[0]:
            p = F.col("n") / F.col("total")
            level = level.withColumn("p", p).withColumn("gamma", F.lit(0.0)).withColumn("entropy", F.sum(-p * F.log2(p)).over(by))
        else:
            shorter = below.select(F.col("context").alias("_short"), "word", F.col("p").alias("q"), F.col("entropy").alias("lower"))
            level = level.withColumn("_short", F.slice("context", 2, k - 2) if k > 2 else F.array().cast("array<int>"))
            level = level.join(shorter, ["_short", "word"]).withColumn("gamma", F.lit(discount) * F.col("types") / F.col("total"))
            p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("q")
            level = level.withColumn("p", p)
            seen = F.sum(-F.col("p") * F.log2("p")).over(by)
            rest = 1 - F.sum("q").over(by)
            low = F.col("lower") + F.sum(F.col("q") * F.log2("q")).over(by)
            level = level.withColumn("entropy", seen - F.col("gamma") * F.log2("gamma") * rest + F.col("gamma") * low)
        below = level.select("order", "context", "word", "n", "p", "gamma", "entropy")
        done = below if done is None else done.unionByName(below)
    return done


def _backed_off(keys: DataFrame, scores: DataFrame, order: int, column: str, word: int | None = None) -> DataFrame:
    """Add ``column``: the interpolated probability of the gram ``key``, or of ``word`` behind the context ``ctx``.

    Where an n-gram was not seen, its context's back-off weight passes to the next shorter context (all of it, where
    the context was not seen either).
    """
    out = keys.withColumn(column, F.lit(0.0))
    for k in range(1, order + 1):
        level = scores.where(F.col("order") == k)
        cut = lambda c, n: F.col(c).bitwiseAND(F.lit((1 << bytearrays.SYMBOL_BITS * n) - 1))
        if word is None:
            hits = level.select(packed(F.col("context"), F.col("word")).alias("_gram"), F.col("p").alias("_p"))
            out = out.withColumn("_gram", cut("key", k)).join(hits, "_gram", "left").drop("_gram")
        else:
            hits = level.where(F.col("word") == word).select(packed(F.col("context")).alias("_c"), F.col("p").alias("_p"))
            out = out.withColumn("_c", cut("ctx", k - 1)).join(hits, "_c", "left").drop("_c")
        if k > 1:
            weights = level.select(packed(F.col("context")).alias("_c"), F.col("gamma").alias("_g")).distinct()
            context = F.shiftright(F.col("key"), bytearrays.SYMBOL_BITS) if word is None else F.col("ctx")
            out = out.withColumn("_c", context.bitwiseAND(F.lit((1 << bytearrays.SYMBOL_BITS * (k - 1)) - 1))).join(weights, "_c", "left").drop("_c")
            out = out.withColumn(column, F.coalesce("_p", F.coalesce("_g", F.lit(1.0)) * F.col(column))).drop("_p", "_g")
        else:
            out = out.withColumn(column, F.coalesce("_p", F.lit(0.0))).drop("_p")
    return out


def _bits(p: str) -> Column:
    return F.when(F.col(p) > 0, -F.log2(p)).otherwise(F.lit(float("inf")))


def score_corpus(docs: DataFrame, scores: DataFrame, order: int) -> DataFrame:
    """(doc_id, pos, byte, surprisal, entropy, space_nll, eos_nll) of every byte of the prefixed texts, in bits.

    The table may come from other texts: unseen n-grams and contexts back off to shorter ones, so no position is lost;
    a byte that the table does not have at all is infinitely surprising. Grams and contexts are looked up once each.
    """
    rows = materialise(bytearrays.gram_rows(docs, order, START, STOP), "grams")
    ctx = F.shiftright(F.col("key"), bytearrays.SYMBOL_BITS)
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    keys = materialise(_backed_off(keys, scores, order, "p").withColumn("ctx", ctx), "gram_scores")
    contexts = materialise(keys.select("ctx").distinct(), "contexts")
    out = contexts.withColumn("entropy", F.lit(None).cast("double"))
    for k in range(1, order + 1):
        level = scores.where(F.col("order") == k).select(packed(F.col("context")).alias("_c"), F.col("entropy").alias("_e")).distinct()
        out = out.withColumn("_c", F.col("ctx").bitwiseAND(F.lit((1 << bytearrays.SYMBOL_BITS * (k - 1)) - 1))).join(level, "_c", "left").drop("_c")
        out = out.withColumn("entropy", F.coalesce("_e", "entropy")).drop("_e")
    for name, word in (("_space", SPACE), ("_stop", STOP)):
        out = out.join(_backed_off(contexts, scores, order, name, word), "ctx")
    table = keys.join(out, "ctx").select("key", _bits("p").alias("surprisal"), "entropy", _bits("_space").alias("space_nll"), _bits("_stop").alias("eos_nll"))
    return rows.join(materialise(table, "scored_grams"), "key").select("doc_id", "pos", F.col("key").bitwiseAND(F.lit(511)).cast("int").alias("byte"), "surprisal", "entropy", "space_nll", "eos_nll")


def byte_probability(scores: DataFrame, order: int, byte: int) -> DataFrame:
    """(context, nll) of one byte or STOP after every seen context of ``order``, -log2 of its interpolated probability,
    backing off where the n-gram was not seen. For the space and end-of-text signals."""
    contexts = scores.where(F.col("order") == order).select("context", "gamma").distinct()
    found = scores.where(F.col("word") == byte)
    out = contexts
    for k in range(order, 0, -1):
        cut = F.slice("context", order - k + 1, k - 1) if k > 1 else F.array().cast("array<int>")
        level = scores.where(F.col("order") == k).select(F.col("context").alias("_c"), F.col("gamma").alias(f"_g{k}")).distinct()
        hit = found.where(F.col("order") == k).select(F.col("context").alias("_c"), F.col("p").alias(f"_p{k}"))
        out = out.withColumn("_c", cut).join(level, "_c", "left").join(hit, "_c", "left").drop("_c")
    value = F.coalesce(F.col("_p1"), F.lit(0.0))
    for k in range(2, order + 1):
        value = F.coalesce(F.col(f"_p{k}"), F.coalesce(F.col(f"_g{k}"), F.lit(1.0)) * value)
    return out.select("context", (-F.log2(value)).alias("nll"))

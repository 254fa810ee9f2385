r"""Benchmark decontamination by spaced seeds, as DataFrame expressions only.

Words are runs of letters and digits, lower-cased. A seed mask fixes which of some consecutive words count; the
others may differ. All masked windows of the benchmark items and of the documents are hashed and joined. Around each
hit, item and document are aligned and compared word by word: a window of ``WINDOW`` aligned words (the whole item if
it is shorter) must agree in at least ``AGREE`` of its words.

The masks are complete: however the words that may differ lie in a window, some mask at some place in it reads none of
them (``LONG_MASKS`` were found by exhaustive search, tests repeat it). Items shorter than the window have masks of
their own, for each length that occurs. So every item of ``LEAST_WORDS`` words or more takes part (shorter ones are in
any text by chance) and every window that agrees enough is found. No hit is dropped.

The seeds of the benchmark are broadcast only if there are at most ``BROADCAST_SEEDS`` (rows of three numbers); a
larger benchmark is joined by shuffling both sides, and adaptive execution splits frequent seeds. Only numbers are
shuffled there; the words around a hit are fetched afterwards.

Defined cases: null and empty texts hold no words and are never contaminated; items of fewer words match nothing; of
rows that share a doc_id or an item_id, the best overlap of any of them counts; a null id is an id like any other; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
AGREE = 0.8
LEAST_WORDS = 5
BROADCAST_SEEDS = 200_000
#: Words that each mask reads (1) or skips (0), for windows of 13 words of which 2 may differ.
LONG_MASKS = ("11110111", "1110110011", "11010010111")
#: A short item's masks read at least this many words, if it has them.
LEAST_WEIGHT = 4


def masks_for(n: int, misses: int) -> list[tuple[int, str]]:
    """(place, mask) for a window of ``n`` words: whichever ``misses`` words differ, one mask reads none of them.

    The window is cut into parts, of which a mask reads all but ``misses``.
    """
    for parts in range(min(misses + 2, n), n + 1):
        sizes = [n // parts + (i < n % parts) for i in range(parts)]
        if parts == n or sum(sorted(sizes)[: parts - misses]) >= LEAST_WEIGHT:
            break
    cut = ["".join(("0" if i in gone else "1") * size for i, size in enumerate(sizes)) for gone in combinations(range(parts), misses)]
    return [(len(m) - len(m.lstrip("0")), m.strip("0")) for m in cut]


def may_differ(n: int, agree: float = AGREE) -> int:
    return n - ceil(n * agree)


#: All masks by default, those for items of ``SPAN`` words or more.
SPAN = LEAST_WORDS
MASKS = tuple(dict.fromkeys([*LONG_MASKS, *(m for n in range(SPAN, WINDOW) for _, m in masks_for(n, may_differ(n)))]))


def words(text: Column) -> Column:
    """Lower-case words as an array; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seed(hashes: Column, at: Column, mask: str) -> Column:
    """The hash of the masked window that starts ``at``; null where it does not fit."""
    taken = [F.get(hashes, at + i) for i, bit in enumerate(mask) if bit == "1"]
    return F.when(at + len(mask) <= F.size(hashes), F.xxhash64(F.lit(mask), *taken))


def _spread(df: DataFrame, hashes: str, at: str, masks: list[str]) -> DataFrame:
    """A row for each mask that fits at each place."""
    return df.withColumn("seed", F.explode(F.array(*(_seed(F.col(hashes), F.col(at), m) for m in masks)))).where(F.col("seed").isNotNull())


def _best_window(same: Column, window: Column) -> Column:
    """(agreeing words, minus the start) of the window with the most agreement, the first of equals."""
    starts = F.sequence(F.lit(0), F.size(same) - window)
    total = lambda i: F.aggregate(F.slice(same, i + 1, window), F.lit(0), lambda a, x: a + x)
    return F.array_max(F.transform(starts, lambda i: F.struct(total(i).alias("n"), (-i).alias("back"))))


def _seeds(items: DataFrame, lengths: list[int], window: int, agree: float) -> tuple[DataFrame, list[str]]:
    """(seed, item, item_at) of all masked windows of the items (item, item_words), and the masks to look for."""
    size = F.size("item_words")
    long_masks = list(LONG_MASKS if (window, may_differ(window, agree)) == (13, 2) else dict.fromkeys(m for _, m in masks_for(window, may_differ(window, agree))))
    short_masks = {n: masks_for(n, may_differ(n, agree)) for n in lengths}
    long_ones = items.where(size >= window).select("item", "item_words", F.posexplode("item_words").alias("item_at", "_"))
    seeds = _spread(long_ones, "item_words", "item_at", long_masks).select("seed", "item", "item_at")
    for n in lengths:
        placed = F.array(*(F.struct(_seed(F.col("item_words"), F.lit(at), m).alias("seed"), F.lit(at).alias("item_at")) for at, m in short_masks[n]))
        seeds = seeds.unionByName(items.where(size == n).select("item", F.inline(placed)))
    return seeds.distinct(), list(dict.fromkeys([*long_masks, *(m for n in lengths for _, m in short_masks[n])]))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, agree: float = AGREE, broadcast: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, item_id, matched_words, window_words, item_start, doc_start: the best verified overlap of each pair."""
    named = benchmark.select("item_id", word_hashes(F.col("text")).alias("item_words")).where(F.size("item_words") >= LEAST_WORDS)
    named = named.withColumn("item", F.xxhash64("item_words"))
    items, size = named.select("item", "item_words").distinct(), F.size("item_words")
    lengths = sorted(r["n"] for r in items.select(size.alias("n")).where(size < window).distinct().collect())
    seeds, masks = _seeds(items, lengths, window, agree)

    hashed = docs.select("doc_id", word_hashes(F.col("text")).alias("doc_words"))
    if seeds.limit(broadcast + 1).count() <= broadcast:
        probes = _spread(hashed.select("doc_id", "doc_words", F.posexplode("doc_words").alias("doc_at", "_")), "doc_words", "doc_at", masks)
        hits = probes.select("doc_id", "doc_words", "doc_at", "seed").join(F.broadcast(seeds), "seed").join(F.broadcast(items), "item")
    else:
        texts = hashed.withColumn("doc", F.xxhash64("doc_words"))
        probes = _spread(texts.select("doc", "doc_words", F.posexplode("doc_words").alias("doc_at", "_")), "doc_words", "doc_at", masks)
        hits = probes.select("doc", "doc_at", "seed").join(seeds, "seed").select("doc", "doc_at", "item", "item_at").distinct()
        hits = hits.join(items, "item").join(texts, "doc")
    low = F.greatest(F.col("item_at") - window + 1, F.lit(0))  # what lies around the hit, however long the item
    hits = hits.select("doc_id", "item", "doc_words", low.alias("low"), (F.col("doc_at") - F.col("item_at") + low).alias("at"), F.slice("item_words", low + 1, 2 * window - 1).alias("part"), F.least(size, F.lit(window)).alias("window_words"))
    same = F.transform("part", lambda w, i: F.coalesce(F.get("doc_words", F.col("at") + i) == w, F.lit(False)).cast("int"))
    scored = hits.select("doc_id", "item", "low", "at", "window_words", _best_window(same, F.col("window_words")).alias("best"))
    scored = scored.where(F.col("best.n") >= F.ceil(F.col("window_words") * F.lit(agree)))
    start = -F.col("best.back")
    rank = F.struct(F.col("best.n").alias("n"), (-(F.col("at") + start)).alias("d"), (-(F.col("low") + start)).alias("i"), F.col("window_words").alias("w"))
    found = scored.groupBy("doc_id", "item").agg(F.max(rank).alias("r"))
    found = found.join(named.select("item", "item_id").distinct(), "item").groupBy("doc_id", "item_id").agg(F.max("r").alias("r"))
    long = lambda c: c.cast("long")
    return found.select("doc_id", "item_id", long(F.col("r.n")).alias("matched_words"), long(F.col("r.w")).alias("window_words"), long(-F.col("r.i")).alias("item_start"), long(-F.col("r.d")).alias("doc_start"))

"""Vocabularies by repeated merging of the best adjacent pair.

The corpus is compressed once, in Spark, to distinct pre-tokens with counts. Pair counts of every round are Spark
aggregates over that dictionary; one pair a round comes to the driver. The best pair is the most frequent one, or the
one of the highest mutual information: its count over the product of its members' counts. Each round's dictionary is written to the shared
folder, as nested array expressions would grow with every round, and the one before is deleted. A dictionary of at most ``DRIVER_WORDS`` rows is merged on the driver instead, with counts kept up to
date incrementally: rounds then cost what the merged words hold, not a pass over the dictionary.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenlake.functions import alphabet
from tokenlake.functions import text as tx
from tokenlake.sources.io import forget, materialise

DRIVER_WORDS = 500_000
FREQUENCY, MUTUAL_INFORMATION = "frequency", "mutual-information"


class Merge(NamedTuple):
    rank: int
    left: int
    right: int
    joined: int
    num_merges: int


def symbols(words: DataFrame) -> DataFrame:
    """(ids, n) from (pretoken, n): byte identifiers without a prefix."""
    table = F.array(*(F.lit(alphabet.BYTE_ID[b]) for b in range(256)))
    return words.select(F.transform(tx.raw_bytes(F.col("pretoken")), lambda b: F.get(table, b)).alias("ids"), "n")


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, n): adjacent identifiers, overlapping ones included."""
    ids = F.col("ids")
    pairs = F.zip_with(F.slice(ids, 1, F.size(ids) - 1), F.slice(ids, 2, F.size(ids) - 1), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return words.where(F.size("ids") > 1).select(F.inline(pairs), "n").groupBy("left", "right").agg(F.sum("n").alias("n"))


def merged(ids: Column, left: int, right: int, joined: int, collapse_runs: bool) -> Column:
    """The identifiers after joining every (left, right).

    With ``collapse_runs`` all places are marked at once, and a run of one identifier becomes a single joined one;
    otherwise places are taken from the left and do not overlap.
    """
    empty = F.array().cast("array<int>")

    if collapse_runs:
        before = lambda x, i: F.coalesce(F.get(ids, i - 1) == left, F.lit(False)) & (i > 0) & (x == right)
        after = lambda x, i: F.coalesce(F.get(ids, i + 1) == right, F.lit(False)) & (x == left)
        kept = F.transform(ids, lambda x, i: F.when(before(x, i), F.lit(-1)).when(after(x, i), F.lit(joined)).otherwise(x))
        return F.filter(kept, lambda x: x >= 0)

    def step(acc: Column, x: Column) -> Column:
        hit = (F.try_element_at(acc, F.lit(-1)) == left) & (x == right)
        return F.when(hit, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.lit(joined)))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(ids, empty, step)


def _best(words: DataFrame, size: int, threshold: int, measure: str) -> tuple[int, int, int] | None:
    """The pair of the highest score among those frequent enough; of equals the one with the smallest ``right * (size + 1) + left``."""
    pairs = pair_counts(words).where(F.col("n") >= threshold)
    score = F.col("n").cast("double")
    if measure == MUTUAL_INFORMATION:
        units = words.select(F.explode("ids").alias("id"), "n").groupBy("id").agg(F.sum("n").cast("double").alias("c"))
        for side in ("left", "right"):  # a vocabulary, small by nature
            pairs = pairs.join(F.broadcast(units.select(F.col("id").alias(side), F.col("c").alias(f"c_{side}"))), side)
        score = score / (F.col("c_left") * F.col("c_right"))
    code = F.col("right").cast("long") * (size + 1) + F.col("left")
    row = pairs.orderBy(F.desc(score), code).limit(1).collect()
    return (row[0]["left"], row[0]["right"], row[0]["n"]) if row else None


class Growth:
    """Identifiers handed out while a vocabulary grows to ``final_size``.

    With token names, a joined token that exists already keeps its identifier and the vocabulary does not grow.
    """

    def __init__(self, size: int, final_size: int, names: list[str] | None = None):
        self.size, self.final_size, self.names = size, final_size, names
        self.known = {t: i for i, t in enumerate(names)} if names is not None else None

    def full(self) -> bool:
        return self.size >= self.final_size

    def join(self, left: int, right: int) -> int:
        if self.names is not None:
            text = self.names[left] + self.names[right].removeprefix(alphabet.CONTINUATION)
            if text in self.known:
                return self.known[text]
            self.names.append(text)
            self.known[text] = self.size
        self.size += 1
        return self.size - 1


def train(words: DataFrame, vocab_size: int, threshold: int = 20, collapse_runs: bool = True, base: int = alphabet.SIZE, driver_words: int = DRIVER_WORDS, measure: str = FREQUENCY) -> list[Merge]:
    """Merges that grow a vocabulary of ``base`` entries to ``vocab_size``; fewer if no pair is frequent enough."""
    return grow(symbols(words), Growth(base, vocab_size), threshold, collapse_runs, driver_words, measure)


def grow(table: DataFrame, growth: Growth, threshold: int = 1, collapse_runs: bool = True, driver_words: int = DRIVER_WORDS, measure: str = FREQUENCY) -> list[Merge]:
    """The merge loop over (ids, n)."""
    if measure not in (FREQUENCY, MUTUAL_INFORMATION):
        raise ValueError(f"unknown measure {measure!r}")
    table = materialise(table.groupBy("ids").agg(F.sum("n").alias("n")), "words")
    if table.limit(driver_words + 1).count() <= driver_words:
        return _grow_local(table, growth, threshold, collapse_runs, measure)
    out: list[Merge] = []
    while not growth.full():
        found = _best(table, growth.size, threshold, measure)
        if found is None:
            break
        left, right, n = found
        new = growth.join(left, right)
        joined = table.select(merged(F.col("ids"), left, right, new, collapse_runs).alias("ids"), "n")
        if measure == FREQUENCY:  # single units are counted for mutual information alone
            joined = joined.where(F.size("ids") > 1)
        before, table = table, materialise(joined, "words")
        forget(before)
        out.append(Merge(len(out), left, right, new, n))
    return out


def join_pair(ids: list[int], left: int, right: int, joined: int, collapse_runs: bool) -> list[int]:
    """One word after a merge."""
    out: list[int] = []
    i = 0
    while i < len(ids):
        if ids[i] == left and i + 1 < len(ids) and ids[i + 1] == right:
            i += 2
            while collapse_runs and left == right and i < len(ids) and ids[i] == right:
                i += 1
            out.append(joined)
        else:
            out.append(ids[i])
            i += 1
    return out


class _Words:
    """A dictionary on the driver, with counts of units and pairs that follow every merge."""

    def __init__(self, rows: list[tuple[list[int], int]]):
        self.words, self.weight = [r[0] for r in rows], [r[1] for r in rows]
        self.pairs: dict[tuple[int, int], int] = defaultdict(int)
        self.units: dict[int, int] = defaultdict(int)
        self.where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for k in range(len(rows)):
            self._add(k, 1)

    def _add(self, k: int, sign: int) -> list[tuple[int, int]]:
        ids, n = self.words[k], sign * self.weight[k]
        found = list(zip(ids, ids[1:], strict=False))
        for x in ids:
            self.units[x] += n
        for pair in found:
            self.pairs[pair] += n
            if sign > 0:
                self.where[pair].add(k)
        return found

    def merge(self, pair: tuple[int, int], joined: int, collapse_runs: bool) -> set[tuple[int, int]]:
        """Join a pair everywhere; the pairs whose counts have changed."""
        changed: set[tuple[int, int]] = set()
        for k in self.where.pop(pair, set()):
            changed.update(self._add(k, -1))
            self.words[k] = join_pair(self.words[k], *pair, joined, collapse_runs)
            changed.update(self._add(k, 1))
        return changed


def _grow_local(table: DataFrame, growth: Growth, threshold: int, collapse_runs: bool, measure: str) -> list[Merge]:
    # units of single-unit words count for mutual information too
    rows = table if measure == MUTUAL_INFORMATION else table.where(F.size("ids") > 1)
    held = _Words([(r["ids"], r["n"]) for r in rows.orderBy("ids").toLocalIterator()])
    heap = [(-n, pair[1], pair[0]) for pair, n in held.pairs.items()]
    heapq.heapify(heap)
    out: list[Merge] = []

    def frequent() -> tuple[int, int] | None:
        while heap:
            n, right, left = heapq.heappop(heap)
            if held.pairs[left, right] == -n:  # else an old entry; the present one is elsewhere on the heap
                return (left, right) if -n >= threshold else None
        return None

    def informative() -> tuple[int, int] | None:
        able = ((n / (held.units[a] * held.units[b]), -b, -a) for (a, b), n in held.pairs.items() if n >= threshold)
        best = max(able, default=None)  # one merge moves the scores of all pairs of its units
        return (-best[2], -best[1]) if best else None

    while not growth.full():
        pair = informative() if measure == MUTUAL_INFORMATION else frequent()
        if pair is None:
            break
        n, joined = held.pairs[pair], growth.join(*pair)
        for p in held.merge(pair, joined, collapse_runs):
            if held.pairs[p] > 0:
                heapq.heappush(heap, (-held.pairs[p], p[1], p[0]))
        out.append(Merge(len(out), *pair, joined, n))
    return out


def tokens(merges: list[Merge]) -> list[str]:
    """The vocabulary's token texts, by identifier."""
    names = alphabet.byte_vocab()
    for m in merges:
        names.append(names[m.left] + names[m.right])
    return names

r"""Line dedup by a log-template tree.

A document's lines are parsed into a tree of fixed depth: by token count, then by the leading ``LEADING`` tokens, then
into templates. Tokens with a digit are variable fields everywhere. Below the leading tokens the rest of a line is cut
into ``PARTS`` even parts. A template leaves some parts open, as variable fields, and fixes the others: lines of
``TWO_FROM`` tokens or more belong to the templates with two open parts, lines of ``ONE_FROM`` or more to those with
one, shorter lines to the one with none. So lines of one leaf whose variable fields lie in at most two parts meet in a
template, and a line that recurs as it is meets itself in all of its own.

A template recurs if at least ``LEAST_DOCUMENTS`` different texts have it; for lines of ``LONG_FROM`` tokens or more,
which do not meet by chance, ``LEAST_LONG`` suffice. The same holds for a run of shorter lines that follow each other
and have ``LONG_FROM`` tokens together: it is held against equal runs as a whole. Documents of equal text count once,
so exact copies do not make their lines recur; they stay copies, for a later stage. Of a recurring template the
document with the smallest id (with its exact copies) keeps its lines; all others lose theirs.

Python turns each line into hashes in Arrow batches, a row a line. Leaves found in one text only are pruned before a
line's templates become rows. Texts are shuffled once, to meet the numbers of their dropped lines.

Defined cases: a null text stays null, without lines; blank lines are never dropped and take no part in runs; a line
repeated within one document counts once; a null doc_id is larger than any other; repeated rows share their fate; an
empty table gives an empty result; extra columns pass through, and helper columns start with ``_``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenlake.llm.common import forget, join_hot, materialise
from tokenlake.session import ship_package

LEADING = 3
PARTS = 4
ONE_FROM = 6
TWO_FROM = 12
LEAST_DOCUMENTS = 3
LONG_FROM = 30
LEAST_LONG = 2

_DIGIT = re.compile("[0-9]").search
_OPEN = {k: list(combinations(range(PARTS), k)) for k in (1, 2)}
_MIX = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LINES = "leaf long, dh long, id {}, line_no int, last int, keys array<long>"


def tokens(line: str) -> list[str]:
    """The line's blank-separated tokens, each one that holds a digit as ``<*>``."""
    parts = line.split(" ")
    return [("<*>" if _DIGIT(t) else t) for t in parts] if _DIGIT(line) else parts


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def _parse(text: str, out: dict[str, list]) -> None:
    """Append the lines of a text that are not blank: leaf, hashes of the parts, number of tokens, and their runs."""
    lines, first = [], len(out["leaf"])
    for number, line in enumerate(text.split("\n")):
        line = line.strip(" ")
        if not line:
            continue
        parts = tokens(line)
        n, rest = len(parts), len(parts) - LEADING
        out["line"].append(number)
        out["size"].append(n)
        out["leaf"].append(_hash(" ".join(parts[:LEADING]), n))
        lines.append(" ".join(parts))
        if n < ONE_FROM:
            out["parts"].append((_hash(lines[-1]), 0, 0, 0))
        else:
            cut = [LEADING + rest * i // PARTS for i in range(PARTS + 1)]
            out["parts"].append([_hash(" ".join(parts[a:b])) for a, b in zip(cut, cut[1:], strict=False)])
    sizes, at, held = out["size"][first:], 0, 0
    for k, n in enumerate(sizes):  # at: one behind the last line of the run that starts with line k
        while held < LONG_FROM and at < len(sizes):
            held, at = held + sizes[at], at + 1
        run = n < LONG_FROM <= held
        out["run"].append(_hash("\n".join(lines[k:at]), 1) if run else 0)
        out["last"].append(out["line"][first + at - 1] if run else -1)
        held -= n


def _mixed(leaf: np.ndarray, parts: list[np.ndarray], kind: int, long: np.ndarray) -> np.ndarray:
    """The key of a template: its leaf and fixed parts, what kind it is, and in the last bit whether its lines are long."""
    total = leaf * _MIX[0] + np.full(1, kind + 1, np.uint64) * _MIX[1]
    for i, part in enumerate(parts):
        total = (total ^ (total >> np.uint64(29))) * _MIX[2] + part * _MIX[3] * np.uint64(2 * i + 1)
    total = (total ^ (total >> np.uint64(32))) * _MIX[1]
    total ^= total >> np.uint64(29)
    return total & ~np.uint64(1) | long


def _keys(found: dict[str, list]) -> tuple[np.ndarray, pa.Array]:
    """Leaves, and the keys of all templates of each line, its run's last."""
    leaf, size = np.array(found["leaf"], np.uint64), np.array(found["size"], np.int64)
    parts, run = np.array(found["parts"], np.uint64).reshape(-1, PARTS), np.array(found["run"], np.uint64)
    long, n = (size >= LONG_FROM).astype(np.uint64), len(leaf)
    table, used = np.zeros((n, len(_OPEN[2]) + 1), np.uint64), np.zeros((n, len(_OPEN[2]) + 1), bool)
    for low, high, opened in ((0, ONE_FROM, [()]), (ONE_FROM, TWO_FROM, _OPEN[1]), (TWO_FROM, None, _OPEN[2])):
        rows = np.flatnonzero((size >= low) & (size < high if high else True))
        for k, gone in enumerate(opened):
            fixed = [parts[rows, i] for i in range(PARTS if opened != [()] else 1) if i not in gone]
            table[rows, k], used[rows, k] = _mixed(leaf[rows], fixed, 8 * len(gone) + k, long[rows]), True
    runs = np.flatnonzero(np.array(found["last"], np.int64) >= 0)
    table[runs, -1], used[runs, -1] = run[runs] | np.uint64(1), True
    ends = np.concatenate([[0], np.cumsum(used.sum(1))])
    return leaf.view(np.int64), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(table[used].view(np.int64)))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, list] = {k: [] for k in ("leaf", "line", "size", "parts", "run", "last")}
        ends = [0]
        for text in batch.column("text").to_pylist():
            if text:
                _parse(text, found)
            ends.append(len(found["leaf"]))
        row = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends)))
        leaf, keys = _keys(found)
        yield pa.record_batch({
            "leaf": pa.array(leaf), "dh": batch.column("dh").take(row), "id": batch.column("id").take(row),
            "line_no": pa.array(found["line"], pa.int32()), "last": pa.array(found["last"], pa.int32()), "keys": keys,
        })


def _ident(docs: DataFrame) -> tuple[Column, str]:
    """An id to order by, of which a null one is the largest, and its type."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "long"
    ident = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    return ident, "struct<none: boolean, id: string>"


def keyed_lines(docs: DataFrame) -> DataFrame:
    """(leaf, dh, id, line_no, last, keys): a row for each line that is not blank; last: the last line of its run, or -1."""
    ident, kind = _ident(docs)
    texts = docs.select(F.xxhash64("text").alias("dh"), ident.alias("id"), "text").where(F.length("text") > 0)
    return texts.mapInArrow(_lines, _LINES.format(kind))


def dropped_lines(docs: DataFrame, least: int = LEAST_DOCUMENTS, least_long: int = LEAST_LONG) -> DataFrame:
    """(dh, drops): for each text that loses lines, whether each of its lines from the first on is to go."""
    lines = materialise(keyed_lines(docs), "lines")
    leaves = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("dh").alias("low"), F.max("dh").alias("high"))
    leaves = materialise(leaves.where(F.col("low") < F.col("high")).select("leaf", "n"), "leaves")
    shared = join_hot(lines, leaves.select("leaf"), "leaf", F.col("dh"), leaves)
    rows = shared.select("dh", "id", "line_no", "last", F.posexplode("keys").alias("k", "key"), F.size("keys").alias("n_keys"))
    last = F.when((F.col("last") >= 0) & (F.col("k") == F.col("n_keys") - 1), F.col("last")).otherwise(F.col("line_no"))
    rows = rows.select("key", "dh", "line_no", last.alias("last"), "id").groupBy("key", "dh", "line_no", "last").agg(F.min("id").alias("id"))
    known = materialise(rows, "templates")  # exact copies are one now
    once = known.groupBy("key", "dh").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    templates = once.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.sum("rows").alias("n"), F.min("id").alias("keeper"))
    enough = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, least_long).otherwise(least)
    templates = materialise(templates.where(F.col("texts") >= enough).select("key", "keeper", "n"), "recurring")
    lost = join_hot(known, templates.select("key", "keeper"), "key", F.col("dh"), templates).where(F.col("id") > F.col("keeper"))
    drops = lost.groupBy("dh").agg(F.collect_set(F.struct("line_no", "last")).alias("drops")).mapInArrow(_flags, "dh long, drops array<boolean>")
    drops = materialise(drops, "drops")
    forget(lines), forget(leaves), forget(known), forget(templates)
    return drops


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for spans in batch.column("drops").to_pylist():
            gone = np.zeros(max(s["last"] for s in spans) + 1, bool)
            for s in spans:
                gone[s["line_no"] : s["last"] + 1] = True
            out.append(pa.array(gone))
        yield pa.record_batch({"dh": batch.column("dh"), "drops": pa.array([x.to_pylist() for x in out], pa.list_(pa.bool_()))})


def dedup(docs: DataFrame, least: int = LEAST_DOCUMENTS, least_long: int = LEAST_LONG, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """The documents without dropped lines, with numbers of lines before and of lines dropped; other columns as they were."""
    ship_package(docs.sparkSession)
    drops = dropped_lines(docs, least, least_long)
    counts = docs.groupBy(F.xxhash64("text").alias("_dh")).agg(F.count(F.lit(1)).alias("n"))
    marked = docs.withColumn("_dh", F.xxhash64("text"))
    out = join_hot(marked, drops.withColumnsRenamed({"dh": "_dh", "drops": "_drops"}), "_dh", F.monotonically_increasing_id(), counts, "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda line, i: ~F.coalesce(F.get("_drops", i), F.lit(False)) | (F.trim(line) == ""))
    out = out.withColumn("_kept", F.when(F.col("_drops").isNotNull(), kept)).withColumn("_n", F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)))
    gone = F.when(F.col("_kept").isNull(), 0).otherwise(F.col("_n") - F.size("_kept"))
    out = out.withColumns({n_lines: F.col("_n").cast("long"), n_dropped: gone.cast("long")})
    return out.withColumn("text", F.coalesce(F.array_join("_kept", "\n"), F.col("text"))).drop("_dh", "_drops", "_kept", "_n")

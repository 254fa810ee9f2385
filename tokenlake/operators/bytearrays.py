"""Documents as byte arrays: kernels over whole Arrow batches, for work that would need a row a byte otherwise.

A document is (data, sizes): the bytes of its prefixed text, and the byte lengths of its pre-tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.functions import text as tx
from tokenlake.session import ship_package

#: Symbols are bytes and two padding marks, so nine bits each; a gram of up to seven fits a long.
SYMBOL_BITS = 9


def by_document(docs: DataFrame, *kept: str) -> DataFrame:
    """(kept, data, sizes) of every document that has a text."""
    sizes = F.transform(tx.pretokens(F.col("text")), F.octet_length)
    return docs.where(F.col("text").isNotNull()).select(*kept, F.encode(tx.prefixed(F.col("text")), "utf-8").alias("data"), sizes.alias("sizes"))


def binary(column: pa.Array) -> list[np.ndarray]:
    """The rows of a binary column, without copies."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column, without copies."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def starts(sizes: np.ndarray, n: int) -> np.ndarray:
    """Where pre-tokens start, as a mask over ``n`` bytes."""
    mask = np.zeros(n, bool)
    if n:
        mask[np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64)] = True
    return mask


def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def gather(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[first[i] : first[i] + size[i]] for all i, joined."""
    ends = np.cumsum(size)
    return values[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def grams(data: np.ndarray, order: int, start: int, stop: int, pad: int) -> np.ndarray:
    """All grams of ``order`` symbols of a document between ``pad`` start and stop symbols, as longs, last symbol lowest."""
    symbols = np.concatenate([np.full(pad, start), data, np.full(pad, stop)]).astype(np.int64)
    n = len(symbols) - order + 1
    key = np.zeros(max(n, 0), np.int64)
    for k in range(order):
        key = (key << SYMBOL_BITS) | symbols[k : k + n]
    return key


def gram_counts(docs: DataFrame, orders: list[int], start: int, stop: int, pad: int) -> DataFrame:
    """(order, key, n): counts of grams, added up in each batch before anything is shuffled."""
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = binary(batch.column("data"))
            for order in orders:
                keys, n = np.unique(joined([grams(x, order, start, stop, pad) for x in rows], np.int64), return_counts=True)
                yield pa.record_batch({"order": pa.array(np.full(len(keys), order, np.int32)), "key": keys, "n": n.astype(np.int64)})

    texts = docs.where(F.col("text").isNotNull()).select(F.encode(tx.prefixed(F.col("text")), "utf-8").alias("data"))
    return texts.mapInArrow(count, "order int, key long, n long").groupBy("order", "key").agg(F.sum("n").alias("n"))


def gram_rows(docs: DataFrame, order: int, start: int, stop: int) -> DataFrame:
    """(doc_id, pos, key): the gram that ends at each byte of the prefixed text."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = binary(batch.column("data"))
            sizes = [len(x) for x in rows]
            owner = pa.array(np.repeat(np.arange(len(rows)), sizes))
            keys = joined([grams(x, order, start, stop, order - 1)[: len(x)] for x in rows], np.int64)
            yield pa.record_batch({"doc_id": batch.column("doc_id").take(owner), "pos": pa.array(joined([np.arange(n) for n in sizes], np.int64), pa.int32()), "key": keys})

    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.encode(tx.prefixed(F.col("text")), "utf-8").alias("data"))
    return texts.mapInArrow(spread, f"doc_id {kind}, pos int, key long")


def with_signal(arrays: DataFrame, signal: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Add ``signal``, an array along ``data`` that follows from the document's bytes alone."""
    ship_package(arrays.sparkSession)

    @F.arrow_udf("array<double>")
    def values(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found = [signal(x) for x in binary(column)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(joined(found, np.float64), pa.float64()))

    return arrays.withColumn("signal", values("data"))

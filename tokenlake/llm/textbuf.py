"""Arrow string columns as flat code-point arrays, so that numpy handles many texts at once, whatever their length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_CHARS = 1 << 18


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def pieces(column, overlap: int, chars: int = PIECE_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points as uint32, offsets, row of each piece), about ``chars`` of text at a time.

    Short texts come whole, several at once. A text longer than ``chars`` comes alone, in pieces that repeat the last
    ``overlap`` code points of the one before: each window of ``overlap + 1`` lies in one piece exactly.
    """
    data, offsets = utf8(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chars, "right")) - 1)
        raw = data[offsets[first] : offsets[last]]
        ends = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets[first : last + 1] - offsets[first]]
        text = raw.tobytes().decode("utf-8", "surrogatepass")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) <= 2 * chars:
            yield points, ends, np.arange(first, last)
        else:
            for at in range(0, max(1, len(points) - overlap), chars):
                part = points[at : at + chars + overlap]
                yield part, np.array([0, len(part)]), np.array([first])
        first = last


def _folded() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for point in range(0x3000):
        low = chr(point).lower()
        table[point] = ord(low) if len(low) == 1 else point
        if chr(point).isspace():
            table[point] = 32
    return table


FOLDED = _folded()


def ngram_buckets(points: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, bucket of the n-gram that starts at each position), of ``2 ** bits`` buckets, by a multiplicative hash."""
    step, mix = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    value = np.zeros(len(points), np.uint64)
    wide = points.astype(np.uint64) + np.uint64(1)
    for n in range(1, max(sizes) + 1):
        if len(points) < n:
            return
        value = value[: len(points) - n + 1] * step + wide[n - 1 :]
        if n in sizes:
            mixed = (value ^ (value >> np.uint64(29))) * mix
            yield n, (mixed >> np.uint64(64 - bits)).astype(np.int64)

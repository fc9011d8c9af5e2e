"""Texts of an Arrow batch as one byte array, with the bounds and hashes of their parts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
_KNOWN = 4096


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value of each 64-bit value (wrapping arithmetic)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_PLACE = mixed(np.arange(1, _KNOWN + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)


def _place(at: np.ndarray) -> np.ndarray:
    if len(at) == 0 or at.max() < _KNOWN:
        return _PLACE[at]
    return mixed((at + 1).astype(np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches with at most `limit` bytes of text, or one document: (rows, bytes, offsets)."""
    for batch in batches:
        data, offsets = texts(batch.column(column))
        i = 0
        while i < len(offsets) - 1:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the number of words in each document."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    inside = ~SPACE[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def part_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: bytes times a random number of their place, summed and mixed with the length."""
    length = ends - starts
    full = length > 0
    out = np.zeros(len(starts), np.uint64)
    if full.any():
        n, first = length[full], np.cumsum(length[full]) - length[full]
        at = np.arange(int(n.sum())) - np.repeat(first, n)
        out[full] = np.add.reduceat(_BYTE[data[at + np.repeat(starts[full], n)]] * _place(at), first)
    return mixed(out ^ mixed(length.astype(np.uint64) + _U(7)))


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n neighbours each: len(hashes) - n + 1 values."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out = mixed(out * _U(0x9E3779B97F4A7C15) + hashes[k : k + len(out)] + _U(k + 1))
    return out

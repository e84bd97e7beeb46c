"""Vectorised text kernels for Arrow batches.

They work on the raw UTF-8 buffer of a batch in slices of about a megabyte, so
that memory stays small whatever a batch holds.  A text is never cut: a longer
one is a slice of its own.  Words are `[^\\x20\\x09-\\x0D]+` after lower-casing
A-Z; they and their shingles are known by 64-bit hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64
GOLDEN = _U(0x9E3779B97F4A7C15)
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x *= _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def word_starts(low: np.ndarray, offsets: np.ndarray, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased bytes start, and per row the number of its first one (rows + 1)."""
    space = gap[low]
    start = ~space
    start[1:] &= space[:-1]
    edges = offsets[:-1][offsets[:-1] < len(low)]
    start[edges] = ~space[edges]
    at = np.flatnonzero(start)
    return at, np.searchsorted(at, offsets)


def words(
    data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = IS_SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and per row the number of the first one (rows + 1).

    ``gap`` marks the bytes that stand between words.  A word's hash is the sum
    of well-mixed values of its (place, byte) pairs: every place has a table of
    its own, so words of few letters in patterns do not meet.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = LOWER[data]
    at, first = word_starts(low, offsets, gap)
    if len(at) == 0:
        return np.zeros(0, np.uint64), first
    place = np.arange(at[0], n)
    place -= np.repeat(at, np.diff(np.append(at, n)))
    place <<= 8
    place += low[at[0] :]
    value = mix((place + 1).astype(np.uint64) * GOLDEN)
    value[gap[low[at[0] :]]] = 0
    return mix(np.add.reduceat(value, at - at[0]) + GOLDEN), first


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, joined, and the row offsets into them.

    A row with 1 to size-1 words has one shingle, its whole sequence; a row
    without words has none.
    """
    w, first = words(data, offsets)
    k = _U(0xC2B2AE3D27D4EB4F)
    full = len(w) - size + 1
    h = np.zeros(max(full, 0), np.uint64)
    for i in range(size):
        if full > 0:
            h = h * k + w[i : i + full]
    h = mix(h)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            s = np.sort(h[a : b - size + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            sets.append(s[keep])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for i in range(a, b):
                x = x * k + w[i]
            sets.append(mix(x))
        else:
            sets.append(np.zeros(0, np.uint64))
    out = np.zeros(len(offsets), np.int64)
    np.cumsum([len(s) for s in sets], out=out[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), out


def release() -> None:
    """Give freed memory back to the system; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values (rows of a matrix, too) between neighbouring offsets; 0 if none."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0)
    return out

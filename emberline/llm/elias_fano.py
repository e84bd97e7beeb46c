"""Elias-Fano coding of ascending integers with constant-time selection.

``n`` values in [0, u] take about 2 + log2(u / n) bits each: the low bits of
every value stand in a packed array, the high bits as gaps in unary.  Value i
is selected from the place of the i-th one among the unary bits; the place of
every ``EVERY``-th one is kept as 32 bits, and the bytes from there are counted.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

EVERY = 256
_HEAD = struct.Struct("<QQBxxxIII")  # values, offset, low bits, bytes of low, high and sample parts
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: place of the k-th one in each byte
_PLACE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8)


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one value after another."""
    if width == 0 or len(values) == 0:
        return b""
    parts = []
    for lo in range(0, len(values), 1 << 17):  # a multiple of 8 values ends at a byte
        octets = np.ascontiguousarray(values[lo : lo + (1 << 17)], "<u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(octets[:, : -(-width // 8)], axis=1, bitorder="little")[:, :width]
        parts.append(np.packbits(bits, bitorder="little").tobytes())
    return b"".join(parts)


def unpack_bits(data: bytes | memoryview, n: int, width: int) -> np.ndarray:
    """The ``n`` values that :func:`pack_bits` packed."""
    out = np.zeros(n, np.uint64)
    if width == 0 or n == 0:
        return out
    raw = np.frombuffer(data, np.uint8)
    for lo in range(0, n, 1 << 17):
        k = min(1 << 17, n - lo)
        at = lo * width // 8
        bits = np.unpackbits(raw[at : at + -(-k * width // 8)], count=k * width, bitorder="little").reshape(k, width)
        octets = np.zeros((k, 8), np.uint8)
        some = np.packbits(bits, axis=1, bitorder="little")
        octets[:, : some.shape[1]] = some
        out[lo : lo + k] = octets.view("<u8").ravel()
    return out


def _bits_at(data: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    """Packed values at the places ``index``; ``data`` ends with 16 spare bytes."""
    if width == 0:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.int64) * width
    first, shift = at >> 3, (at & 7).astype(np.uint64)
    window = data[first[:, None] + np.arange(9)]
    low = np.ascontiguousarray(window[:, :8]).view("<u8").ravel() >> shift
    rest = window[:, 8].astype(np.uint64)
    high = np.where(shift > 0, rest << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    mask = np.uint64((1 << width) - 1)
    return (low | high) & mask


@dataclass
class EliasFano:
    """Ascending 64-bit integers, stored as differences to the first."""

    n: int
    offset: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """Code of ascending values (signed or not); equal neighbours are allowed."""
        n = len(values)
        if n == 0:
            return cls(0, 0, 0, np.zeros(16, np.uint8), np.zeros(1, np.uint8), np.zeros(0, np.uint32))
        first, last = int(values[0]), int(values[-1])
        rest = values.astype(np.uint64) - np.uint64(first % (1 << 64))  # modulo 2**64, so that signs do not matter
        width = max(0, ((last - first) // n).bit_length() - 1)
        place = (rest >> np.uint64(width)).astype(np.int64) + np.arange(n)
        if int(place[-1]) >= 1 << 32:
            raise ValueError("too many values for one code")
        bits = np.zeros(int(place[-1]) + 1, np.uint8)
        bits[place] = 1
        low = np.frombuffer(pack_bits(rest, width) + bytes(16), np.uint8)
        return cls(n, first, width, low, np.packbits(bits, bitorder="little"), place[::EVERY].astype(np.uint32))

    def to_bytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()]
        return _HEAD.pack(self.n, self.offset % (1 << 64), self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes | memoryview, signed: bool = False) -> tuple[EliasFano, int]:
        """The code at the start of ``data`` and how many bytes it takes."""
        n, offset, width, *sizes = _HEAD.unpack_from(data)
        if signed and offset >= 1 << 63:
            offset -= 1 << 64
        at, parts = _HEAD.size, []
        for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4")):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, offset, width, *parts), at

    def select(self, index: np.ndarray) -> np.ndarray:
        """Values at the places ``index`` (0 to n - 1), modulo 2**64."""
        index = np.asarray(index, np.int64)
        if len(index) and not (0 <= index.min() and index.max() < self.n):
            raise IndexError("no such value")
        start = self.samples[index // EVERY].astype(np.int64)
        byte, inside = start >> 3, start & 7
        # ones still to pass, counted from the start of the byte
        left = index % EVERY + _ONES[self.high[byte] & ((1 << inside) - 1).astype(np.uint8)]
        open_ = np.arange(len(index))
        while len(open_):
            ones = _ONES[self.high[byte[open_]]]
            on = left[open_] >= ones
            open_, ones = open_[on], ones[on]
            left[open_] -= ones
            byte[open_] += 1
        place = (byte << 3) + _PLACE[self.high[byte], left]
        high = (place - index).astype(np.uint64) << np.uint64(self.low_bits)
        return (high | _bits_at(self.low, index, self.low_bits)) + np.uint64(self.offset % (1 << 64))

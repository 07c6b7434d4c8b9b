"""Elias-Fano coding of a non-decreasing sequence with a select structure.

Each value's ``low`` bits are stored as they are; the rest go into a bit vector that
has, for the i-th value, a one at (value >> low) + i. That is about 2 + log2(u / n) bits a
value. ``select`` finds the i-th one from a sample of every 256th.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QBQQ")  # count, low bits, bytes of the bit vector, first value
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of the j-th one of a byte (little-endian bits).
_PLACE = np.array([[*[k for k in range(8) if i >> k & 1], *[0] * 8][:8] for i in range(256)], np.uint8)


def encode(values: np.ndarray) -> bytes:
    """Code of non-decreasing int64 values (stored relative to the first)."""
    first = int(values[0]) if len(values) else 0
    v = values.astype(np.uint64) - np.uint64(first & 0xFFFFFFFFFFFFFFFF)
    n = len(v)
    top = int(v[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n and top else 0
    high = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros((int(high[-1]) // 8 + 1) * 8 if n else 0, np.uint8)
    bits[high] = 1
    vector = np.packbits(bits, bitorder="little").tobytes()
    lows = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    samples = high[::SAMPLE].astype(np.uint32).tobytes()
    return _HEAD.pack(n, low, len(vector), first & 0xFFFFFFFFFFFFFFFF) + samples + vector + np.packbits(lows.ravel(), bitorder="little").tobytes()


class EliasFano:
    """Read access to a code that starts at ``at`` of ``data``."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        self.n, self.low, size, first = _HEAD.unpack_from(data, at)
        self.first = first - (1 << 64) if first >> 63 else first
        at += _HEAD.size
        count = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, np.uint32, count, at)
        at += 4 * count
        self.vector = np.frombuffer(data, np.uint8, size, at)
        at += size
        self.lows = np.frombuffer(data, np.uint8, -(-self.n * self.low // 8), at)
        self.end = at + len(self.lows)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Bit position of the i-th one, from the nearest sample on."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = place // 8
        left += int(_ONES[self.vector[byte] & ((1 << place % 8) - 1)])
        while (ones := int(_ONES[self.vector[byte]])) <= left:
            left -= ones
            byte += 1
        return 8 * byte + int(_PLACE[self.vector[byte], left])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        low = 0
        for k in range(self.low):
            p = i * self.low + k
            low |= (int(self.lows[p >> 3]) >> (p & 7) & 1) << k
        return self.first + ((self.select(i) - i) << self.low | low)

    def all(self) -> np.ndarray:
        """Every value as int64: one select for all, by running counts of ones a byte."""
        index = np.arange(self.n)
        upto = np.cumsum(_ONES[self.vector], dtype=np.int64)
        byte = np.searchsorted(upto, index, "right")
        before = np.where(byte > 0, upto[byte - 1], 0)
        high = 8 * byte + _PLACE[self.vector[byte], index - before] - index
        bits = np.unpackbits(self.lows, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
        low = (bits.astype(np.int64) << np.arange(self.low)).sum(axis=1) if self.low else 0
        return (high.astype(np.int64) << self.low) + low + self.first

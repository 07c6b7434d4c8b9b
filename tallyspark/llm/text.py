"""Vectorised text helpers used inside tasks (numpy over concatenated documents).

Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes; the separators are ASCII, so
splitting bytes and splitting code points agree.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(29)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(32)
    return x


#: A scrambled 64-bit symbol per byte value.
BYTE_SYMBOL = mix(np.arange(1, 257, dtype=U64) * U64(BASE))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        step = np.full(size, BASE, U64)
        step[0] = 1
        _powers = np.multiply.accumulate(step)
        step = np.full(size, _INVERSE, U64)
        step[0] = 1
        _inverses = np.multiply.accumulate(step)
    return _powers, _inverses


class Rolling:
    """Position-independent 64-bit hashes of any slice of a symbol sequence."""

    def __init__(self, symbols: np.ndarray):
        power, self._inverse = _tables(len(symbols) + 1)
        self._sums = np.zeros(len(symbols) + 1, U64)
        np.cumsum(symbols * power[: len(symbols)], out=self._sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Hash of each full slice of ``length`` symbols, by start."""
        n = max(0, len(self._sums) - length)
        return mix((self._sums[length : length + n] - self._sums[:n]) * self._inverse[:n])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the slices [start, end); the length takes part."""
        raw = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, one space after each; start and end of each text."""
    texts = [t or b"" for t in texts]
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(sizes[:-1] + 1, out=starts[1:])
    return data, starts, starts + sizes


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of bytes that end with a separator."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.empty(len(gap), bool)
    before[:1] = True
    before[1:] = gap[:-1]
    return np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Rolling(BYTE_SYMBOL[data]).slices(begin, end)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (block prefix / suffix minima)."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def covered(starts: np.ndarray, length, size: int) -> np.ndarray:
    """Mask over ``size`` positions of those inside any [start, start + length)."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def chunks(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cut consecutive documents into runs of about ``most`` bytes (one long document alone)."""
    out, first, total = [], 0, 0
    for i, s in enumerate(sizes.tolist()):
        if total and total + s > most:
            out.append((first, i))
            first, total = i, 0
        total += s + 1
    if first < len(sizes):
        out.append((first, len(sizes)))
    return out

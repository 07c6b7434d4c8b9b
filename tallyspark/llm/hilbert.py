"""Hilbert curve keys of points, and the shifted projections that operator 6 orders vectors by."""

from __future__ import annotations

import numpy as np

DIMS, BITS = 6, 10


def keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each grid cell (rows of non-negative ints below 2^bits) on the Hilbert curve, as int64.

    Skilling's transform: undo the excess work from the top bit down, Gray-encode, and
    interleave the bits of all axes.
    """
    x = [cells[:, i].astype(np.int64).copy() for i in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[i] ^ t) >> b & 1)
    return out


def frame(curve: int, width: int, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal projection and shift (in cells of the unit range) of a curve, the same everywhere."""
    g = np.random.default_rng([width, curve])
    q, _ = np.linalg.qr(g.standard_normal((width, max(min(dims, width), 1))))
    return q, g.random(q.shape[1])


def curve_keys(vectors: np.ndarray, curve: int) -> np.ndarray:
    """Curve keys of unit vectors: projected, scaled by the usual spread, shifted by up to half the range."""
    width = vectors.shape[1]
    q, shift = frame(curve, width)
    scaled = (vectors @ q) * np.sqrt(width) / 8 + 0.25 + 0.5 * shift  # 4 spreads = half the range
    return keys(np.clip(scaled * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))

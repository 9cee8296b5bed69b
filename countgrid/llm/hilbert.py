"""Hilbert keys of integer points, vectorised over rows.

The index is built one bit plane at a time from the most significant plane
down. Each plane turns into a Gray-code rank in the current orientation of the
curve, and the orientation (an entry corner and a direction per row) is then
updated; see C. Hamilton, "Compact Hilbert Indices", 2006.
"""

from __future__ import annotations

import numpy as np


def _rotate_right(x: np.ndarray, by: np.ndarray, dims: int) -> np.ndarray:
    mask = np.uint64((1 << dims) - 1)
    return ((x >> by) | (x << (np.uint64(dims) - by))) & mask


def _rotate_left(x: np.ndarray, by: np.ndarray, dims: int) -> np.ndarray:
    mask = np.uint64((1 << dims) - 1)
    return ((x << by) | (x >> (np.uint64(dims) - by))) & mask


def _gray_inverse(g: np.ndarray, dims: int) -> np.ndarray:
    x, step = g.copy(), 1
    while step < dims:
        x ^= x >> np.uint64(step)
        step *= 2
    return x


def _trailing_ones(x: np.ndarray) -> np.ndarray:
    low = ~x & (x + np.uint64(1))
    return np.bitwise_count(low - np.uint64(1)).astype(np.uint64)


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """``points``: rows of ``dims`` integers below ``2**bits``; dims * bits <= 63."""
    n, dims = points.shape
    if dims * bits > 63:
        raise ValueError("dims * bits must be at most 63")
    one, d = np.uint64(1), np.uint64(dims)
    pts = points.astype(np.uint64)
    entry = np.zeros(n, np.uint64)
    direction = np.zeros(n, np.uint64)
    key = np.zeros(n, np.uint64)
    weights = (one << np.arange(dims, dtype=np.uint64))[None, :]
    for plane in range(bits - 1, -1, -1):
        corner = (((pts >> np.uint64(plane)) & one) * weights).sum(axis=1, dtype=np.uint64)
        turned = _rotate_right(corner ^ entry, (direction + one) % d, dims)
        rank = _gray_inverse(turned, dims)
        key = (key << d) | rank
        # entry corner and direction of the sub-cube with this rank
        even = np.where(rank > 0, (rank - one) & ~one, np.uint64(0))
        gray = np.where(rank > 0, even ^ (even >> one), np.uint64(0))
        odd = np.where(rank % np.uint64(2) == 1, rank, np.where(rank > 0, rank - one, np.uint64(0)))
        step = np.where(rank > 0, _trailing_ones(odd), np.uint64(0)) % d
        entry ^= _rotate_left(gray, (direction + one) % d, dims)
        direction = (direction + step + one) % d
    return key.astype(np.int64)

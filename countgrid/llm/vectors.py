"""Packed sparse rows as standardised numpy vectors.

The similarity of two rows is the Pearson correlation over all ``dims``
features, zeros included: the inner product of their standardised rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row bounds of a list array without null lists."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _sums(at: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Weighted counts as floats, for empty input too."""
    return np.bincount(at, weights, n).astype(np.float64) if n else np.zeros(0)


def standardised(genes: pa.Array, counts: pa.Array, dims: int, dtype: type = np.float32) -> np.ndarray:
    """Dense rows of mean 0 and length 1; a row of equal values is all zeros (no correlation)."""
    columns, bounds = flat_lists(genes)
    values, _ = flat_lists(counts)
    n = len(bounds) - 1
    rows = np.repeat(np.arange(n), np.diff(bounds))
    dense = np.zeros((n, dims), dtype)
    dense[rows, columns] = values
    values = values.astype(np.float64)
    total = _sums(rows, values, n)
    squares = _sums(rows, values * values, n)
    spread = squares - total * total / dims
    scale = np.where(spread > 1e-12 * np.maximum(squares, 1e-300), 1.0 / np.sqrt(np.maximum(spread, 1e-300)), 0.0)
    dense -= (total / dims)[:, None].astype(dtype)
    dense *= scale[:, None].astype(dtype)
    return dense


def pack_rows(genes: pa.Array, counts: pa.Array, dims: int) -> pa.Array:
    """Sparse rows as binary values without loss: a byte that names the form, the feature ids, the values.

    Ids take two bytes where all fit. Values take one byte where all of the rows given are whole numbers below 256, else four.
    """
    columns, bounds = flat_lists(genes)
    values, _ = flat_lists(counts)
    small = bool(((values >= 0) & (values < 256) & (values == np.floor(values))).all())
    ids = np.ascontiguousarray(columns.astype("<u2" if dims <= 1 << 16 else "<u4"))
    data = np.ascontiguousarray(values.astype("u1" if small else "<f4"))
    a, b = ids.itemsize, data.itemsize
    n = np.diff(bounds)
    starts = np.concatenate([[0], np.cumsum(1 + n * (a + b))])
    out = np.zeros(starts[-1], np.uint8)
    out[starts[:-1]] = b
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(columns)) - bounds[row]
    for parts, width, at in ((ids, a, starts[row] + 1 + within * a), (data, b, starts[row] + 1 + n[row] * a + within * b)):
        flat = parts.view(np.uint8).reshape(-1, width)
        for k in range(width):
            out[at + k] = flat[:, k]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def unpack_rows(packed: pa.Array, dims: int) -> tuple[pa.Array, pa.Array]:
    """The lists of feature ids and values of rows from ``pack_rows``, whatever their forms."""
    packed = packed.cast(pa.large_binary())
    _, offsets, data = packed.buffers()
    starts = np.frombuffer(offsets, np.int64)[packed.offset : packed.offset + len(packed) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 2 if dims <= 1 << 16 else 4
    form = raw[starts[:-1]].astype(np.int64)
    n = (np.diff(starts) - 1) // (a + form)
    bounds = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(bounds[-1]) - bounds[row]
    ids = np.zeros(bounds[-1], np.int64)
    for k in range(a):
        ids |= raw[starts[row] + 1 + within * a + k].astype(np.int64) << (8 * k)
    values = np.zeros(bounds[-1], np.float32)
    for width in np.unique(form[n > 0]).tolist():
        own = np.nonzero(form[row] == width)[0]
        at = starts[row[own]] + 1 + n[row[own]] * a + within[own] * width
        cells = np.stack([raw[at + k] for k in range(width)], 1)
        values[own] = cells[:, 0] if width == 1 else np.ascontiguousarray(cells).view("<f4")[:, 0]
    lists = pa.array(bounds.astype(np.int32))
    return pa.ListArray.from_arrays(lists, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(lists, pa.array(values))


def hashed(genes: pa.Array, counts: pa.Array, dims: int, buckets: int, weights: np.ndarray | None = None, seed: int = 7) -> np.ndarray:
    """Hashed weighted features of the rows, of mean 0 over all ``dims`` features and length 1.

    Each feature adds its value, times its weight if any are given, to one of ``buckets`` columns under a
    sign. Where all features fit they get columns of their own and signs don't matter: then inner
    products are exact; else their standard error is about 1 / sqrt(buckets).
    """
    if dims <= buckets and weights is None:
        return standardised(genes, counts, dims)
    columns, bounds = flat_lists(genes)
    values, _ = flat_lists(counts)
    values = values.astype(np.float64) * (1.0 if weights is None else weights[columns])
    n = len(bounds) - 1
    rows = np.repeat(np.arange(n), np.diff(bounds))
    spot, sign = hash_features(np.arange(dims, dtype=np.uint64), buckets, seed) if dims > buckets else (np.arange(dims), np.ones(dims))
    width = min(dims, buckets)
    out = _sums(rows * width + spot[columns], values * sign[columns], n * width).reshape(n, width)
    total, squares = _sums(rows, values, n), _sums(rows, values * values, n)
    out -= (total / dims)[:, None] * _sums(spot, sign, width)
    spread = squares - total * total / dims
    scale = np.where(spread > 1e-12 * np.maximum(squares, 1e-300), 1.0 / np.sqrt(np.maximum(spread, 1e-300)), 0.0)
    return (out * scale[:, None]).astype(np.float32)


def hash_features(ids: np.ndarray, buckets: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each feature id."""
    from countgrid.llm.words import mix64

    with np.errstate(over="ignore"):
        h = mix64(ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return (h >> np.uint64(1)).astype(np.int64) % buckets, np.where(h & np.uint64(1), 1.0, -1.0)

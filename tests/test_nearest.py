import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from countgrid.operators import similarity


def _packed(x, ids=None):
    lists = [np.nonzero(r)[0].astype(np.int32) for r in x]
    return pa.table({
        "id": pa.array(np.arange(len(x)) if ids is None else ids, pa.int64()),
        "features": pa.array([f.tolist() for f in lists], pa.list_(pa.int32())),
        "values": pa.array([x[i, f].astype(float).tolist() for i, f in enumerate(lists)], pa.list_(pa.float64())),
    })


def _clustered(rows=400, features=300, groups=8):
    rng = np.random.default_rng(5)
    means = rng.gamma(0.05, 20, (groups, features))
    x = rng.poisson(means[rng.integers(groups, size=rows)] + 0.02).astype(float)
    x[11] = x[12] = x[13]  # ties
    x[20] = 0  # constant
    x[30] = 2
    return x


def _brute(x, n, k, threshold):
    full = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    with np.errstate(all="ignore"):
        score = np.round(np.corrcoef(full), 9)
    out = set()
    for i, row in enumerate(score):
        near = sorted((-s, j) for j, s in enumerate(row) if j != i and s > threshold)
        out |= {(i, j) for _, j in near[:k]}
    return out


@pytest.mark.parametrize(("k", "threshold", "tile"), [(5, 0.2, 64), (3, -0.9, 37), (500, 0.1, 128)])
def test_bounded_search_is_exact_and_compares_few_pairs(monkeypatch, k, threshold, tile):
    x, n = _clustered(), 320
    compared = []
    exact = similarity._Side.exact
    monkeypatch.setattr(similarity._Side, "exact", lambda self, rows, *rest: (compared.append(len(rows)), exact(self, rows, *rest))[1])
    monkeypatch.setattr(similarity, "MOST_CANDIDATES", 1000)
    table = _packed(x)
    alone = similarity._nearest(table, table, True, n, k, threshold, tile)
    assert set(zip(alone["id0"].to_pylist(), alone["id1"].to_pylist())) == _brute(x, n, k, threshold)
    if k == 5:
        assert sum(compared) < 5 * k * len(x)
    left, right = _packed(x[:150]), _packed(x[150:], np.arange(150, len(x)))
    parts = [similarity._nearest(*p, n, k, threshold, tile) for p in ((left, left, True), (right, right, True), (left, right, False))]
    every = similarity._best_rows(pa.concat_tables(parts), k)
    assert set(zip(every["id0"].to_pylist(), every["id1"].to_pylist())) == _brute(x, n, k, threshold)
    empty = table.slice(0, 0)
    assert similarity._nearest(empty, empty, True, n, k, threshold, tile).num_rows == 0
    assert similarity._nearest(table, empty, False, n, k, threshold, tile).num_rows == 0


def test_tiles_of_near_rows_come_first(monkeypatch):
    """Two blocks of the same clusters: what the tiles beside the diagonal find keeps most others from being multiplied."""
    rng = np.random.default_rng(8)
    n, k, tile = 300, 3, 40
    centres = rng.poisson(3.0, (20, n)) * (rng.random((20, n)) < 0.3)
    x = np.maximum(centres[np.repeat(np.arange(20), 80)] + rng.integers(0, 3, (1600, n)), 0)[rng.permutation(1600)]
    multiplied, offer = [], similarity._Side.offer
    monkeypatch.setattr(similarity._Side, "offer", lambda self, p, o, score, *rest: multiplied.append(score.size) or offer(self, p, o, score, *rest))
    left, right = _packed(x[:800]), _packed(x[800:], np.arange(800, 1600))
    parts = [similarity._nearest(*p, n, k, 0.1, tile) for p in ((left, left, True), (right, right, True), (left, right, False))]
    every = similarity._best_rows(pa.concat_tables(parts), k)
    assert set(zip(every["id0"].to_pylist(), every["id1"].to_pylist())) == _brute(x, n, k, 0.1)
    assert sum(multiplied) < 1_500_000


def test_long_rows_are_compared_by_ranges_of_their_features():
    rng = np.random.default_rng(6)
    n, m = 150_000, 60
    x = np.zeros((m, 150_000), np.float32)
    x[np.repeat(np.arange(m), 3000), rng.integers(n, size=3000 * m)] = rng.integers(1, 9, 3000 * m)
    x[:, :500] = rng.integers(0, 9, (m, 500))
    table = _packed(x)
    want = np.corrcoef(x.astype(float))
    tracemalloc.start()
    _, _, score = similarity.pearson_tiles(table, table, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.abs(score - want).max() < 2e-9
    assert peak < 110e6  # 2 x 72 MB at once before


def test_whole_numbers_are_multiplied_in_single_precision_only_where_it_is_exact():
    rng = np.random.default_rng(10)
    x = rng.integers(0, 200, (70, 90)) * (rng.random((70, 90)) < 0.4)
    for rows, kind in ((x, np.float32), (x + 0.5, np.float64), (x * 1000 + 1, np.float64)):
        left, right = _packed(rows[:30]), _packed(rows[30:])
        dots, (sx, _), _ = similarity.dot_tiles(left, right, 90)
        assert dots.dtype == kind and np.array_equal(dots.astype(np.float64), rows[:30].astype(np.float64) @ rows[30:].T.astype(np.float64)) and np.array_equal(sx, rows[:30].sum(axis=1))

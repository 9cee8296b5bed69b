import numpy as np
import pyarrow as pa
import pytest

from countgrid.llm import clusters, queries_clusters
from countgrid.llm.clusters import similarity_clusters
from countgrid.llm.hilbert import hilbert_key
from countgrid.llm.neighbours import nearest_rows
from countgrid.llm.vectors import hashed, pack_rows, standardised, unpack_rows

DIMS = 60


@pytest.mark.parametrize("dims,bits", [(1, 5), (2, 4), (3, 3), (5, 2)])
def test_hilbert_curve_visits_every_cell_in_unit_steps(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = hilbert_key(grid, bits)
    order = np.argsort(key)
    assert (key[order] == np.arange(len(grid))).all()
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def matrix(seed=3):
    """Three clusters of 40, one of 3, ten loners; a copy of row 0 and a row of equal values."""
    rng = np.random.default_rng(seed)
    rows = []
    for size in (40, 40, 40, 3):
        centre = rng.gamma(0.3, 8, DIMS).round()
        rows += [np.maximum(0, (centre * rng.uniform(0.8, 1.25, DIMS)).round()) for _ in range(size)]
    rows += [(rng.random(DIMS) < 0.05) * rng.integers(1, 9, DIMS) for _ in range(10)]
    rows += [rows[0].copy(), np.full(DIMS, 4.0)]
    return np.array(rows, float)


def frame(spark, x, ids=None):
    data = [(int(ids[i]) if ids is not None else i, [int(g) for g in np.nonzero(r)[0]], [float(v) for v in r[r > 0]], "x") for i, r in enumerate(x)]
    data += [(None, [1], [1.0], "x"), (10_000, None, None, "x"), (10_001, [], [], "x")]
    return spark.createDataFrame(data, "cell_id int, genes array<int>, counts array<float>, cluster_id string")


def pearson(x):
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(np.corrcoef(x), nan=-2.0)


def test_vectors():
    x = matrix()
    genes = pa.array([np.nonzero(r)[0].astype(np.int32) for r in x], pa.list_(pa.int32()))
    counts = pa.array([r[r > 0].astype(np.float32) for r in x], pa.list_(pa.float32()))
    z = standardised(genes.slice(2), counts.slice(2), DIMS)
    assert np.abs(z @ z.T - np.where(pearson(x)[2:, 2:] == -2, 0, pearson(x)[2:, 2:])).max() < 1e-5
    assert (hashed(genes, counts, DIMS, 4096) == standardised(genes, counts, DIMS)).all()
    wide = np.random.default_rng(2).gamma(0.5, 4, (30, 6000)).astype(np.float32)
    packed = [pa.array(list(r), pa.list_(t)) for r, t in ((np.tile(np.arange(6000, dtype=np.int32), (30, 1)), pa.int32()), (wide, pa.float32()))]
    h = hashed(*packed, 6000, 4096)
    assert np.sqrt(np.mean((h @ h.T - np.corrcoef(wide)) ** 2)) < 2 / np.sqrt(4096)
    weights = np.linspace(0.1, 2, DIMS)
    weighted = hashed(genes, counts, DIMS, 4096, weights)[:-1]
    assert np.abs(weighted @ weighted.T - np.corrcoef(x[:-1] * weights)).max() < 1e-5


def test_neighbours_against_brute_force(spark):
    x = matrix()
    got = nearest_rows(frame(spark, x), DIMS, 5).collect()
    s = pearson(x).round(9)
    np.fill_diagonal(s, -3)
    found = {}
    for r in got:
        found.setdefault(r["cell_id"], {})[r["rank"]] = (r["other_id"], r["similarity"])
    want = {i: [j for j in np.lexsort((np.arange(len(s)), -s[i]))[:5] if s[i, j] > -2] for i in range(len(s) - 1)}
    hits = sum(len({o for o, _ in found.get(i, {}).values()} & set(want[i])) for i in want)
    assert hits >= 0.97 * sum(map(len, want.values()))
    assert len(x) - 1 not in found and found[0][1] == (len(x) - 2, 1.0)
    for own in found.values():
        assert [own[k + 1] for k in range(len(own))] == sorted(own.values(), key=lambda p: (-p[1], p[0]))


def test_copies_in_any_number_give_the_smallest_ids(spark):
    """900 copies in shuffled places, more than a row's window of three blocks; a close row that has them as neighbours."""
    x = matrix()
    close = x[0].copy()
    close[np.nonzero(close)[0][0]] += 1
    x = np.concatenate([x, np.repeat(x[:1], 900, axis=0), close[None]])[np.random.default_rng(4).permutation(len(x) + 901)]
    s = pearson(x).round(9)
    np.fill_diagonal(s, -3)
    found = {}
    for r in nearest_rows(frame(spark, x), DIMS, 5).collect():
        found.setdefault(r["cell_id"], {})[r["rank"]] = r["other_id"]
    copies = np.nonzero((s == 1).sum(axis=1) > 800)[0]
    assert len(copies) == 902
    for i in [*copies, int(s[:, copies[0]].argsort()[-903])]:
        assert [found[i][r + 1] for r in range(5)] == list(np.lexsort((np.arange(len(s)), -s[i]))[:5])


def test_packed_rows_come_back():
    rng = np.random.default_rng(3)
    for dims, values in ((500, lambda n: rng.integers(0, 256, n)), (500, lambda n: rng.random(n) * 1e6), (90_000, lambda n: rng.integers(1, 9, n)), (70_000, lambda n: rng.random(n))):
        genes = [np.sort(rng.choice(dims, n, False)).tolist() for n in (3, 0, 40, 1)]
        counts = [np.float32(values(len(g))).tolist() for g in genes]
        lists = pa.array(genes, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))
        packed = pack_rows(*lists, dims)
        assert [c.to_pylist() for c in unpack_rows(packed, dims)] == [genes, counts]
        assert [c.to_pylist() for c in unpack_rows(packed.slice(1, 2), dims)] == [genes[1:3], counts[1:3]]
    both = pa.concat_arrays([pack_rows(pa.array([[1, 7]], pa.list_(pa.int32())), pa.array([v], pa.list_(pa.float32())), 9) for v in ([1, 2], [0.5, 300])])
    assert unpack_rows(both, 9)[1].to_pylist() == [[1, 2], [0.5, 300]]
    assert unpack_rows(pack_rows(pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(pa.float32())), 9), 9)[0].to_pylist() == []


def test_neighbours_do_not_depend_on_the_partitioning(spark):
    x = matrix()
    found = []
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            found.append({tuple(r) for r in nearest_rows(frame(spark, x), DIMS, 5, window=16, curves=6, group_rows=64).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and len(found[0]) > 600


def test_small_windows_still_agree_with_the_exact_similarity(spark):
    x = matrix()
    s = pearson(x)
    for r in nearest_rows(frame(spark, x), DIMS, 3, window=8, curves=4).collect():
        assert abs(r["similarity"] - s[r["cell_id"], r["other_id"]]) < 1e-5 and r["cell_id"] != r["other_id"]


def test_clusters(spark):
    x = matrix()
    ids = np.arange(len(x)) * 7 + 3
    members, clusters = similarity_clusters(frame(spark, x, ids), DIMS, join_similarity=0.6, min_size=5)
    got = {r["cell_id"]: r["cluster_id"] for r in members.collect()}
    want = {int(ids[i]): int(ids[g * 40]) for g in range(3) for i in [*range(g * 40, g * 40 + 40)]} | {int(ids[-2]): int(ids[0])}
    assert got == want
    s = pearson(x)
    for r in clusters.collect():
        own = np.array([i for i in range(len(x)) if got.get(int(ids[i])) == r["cluster_id"]])
        mean = s[np.ix_(own, own)].mean(axis=1)
        assert r["vertex_count"] == len(own) and abs(r["mean_similarity"] - mean.mean()) < 1e-5
        assert abs(mean[np.isin(ids[own], r["typical_cells"])].min() - np.sort(mean)[-3]) < 1e-6


def groups(sizes, inside, across, loners, dims=400, seed=6):
    """Rows whose pairs have about these similarities within and across groups, as positive counts."""
    rng = np.random.default_rng(seed)
    common, own, noise = np.sqrt(across), np.sqrt(inside - across), np.sqrt(1 - inside)
    # Orthogonal parts of mean 0 keep the similarities exact.
    q = np.linalg.qr(np.column_stack([np.ones(dims), rng.standard_normal((dims, dims - 1))]))[0].T[1:]
    rows, at = [], 1 + len(sizes)
    for g, size in enumerate(sizes):
        for _ in range(size):
            rows.append(common * q[0] + own * q[1 + g] + noise * q[at])
            at += 1
    rows += [q[at + i] for i in range(loners)]
    return np.array(rows) * 100 + 100


def test_clusters_at_the_stated_bounds(spark):
    """Pairs at 0.43 within a group and 0.35 across: neither a small group beside a large one nor the large one is lost."""
    sizes = (150, 5, 60, 7)
    x = groups(sizes, 0.43, 0.35, 20)
    s = pearson(x)
    label = np.repeat(np.arange(4), sizes)
    same = label[:, None] == label[None, :]
    n = len(label)
    assert s[:n, :n][same].min() >= 0.42 and s[:n, :n][~same].max() <= 0.36 and np.abs(s[n:] - np.eye(len(x))[n:]).max() < 0.1
    members, _ = similarity_clusters(frame(spark, x), 400, join_similarity=0.39, min_size=5)
    first = np.concatenate([[0], np.cumsum(sizes)])[label]
    assert {r["cell_id"]: r["cluster_id"] for r in members.collect()} == dict(enumerate(first.tolist()))


@pytest.mark.parametrize("sizes,inside,across", [((40, 40), 0.431, 0.355), ((40,) * 4, 0.431, 0.359), ((40,) * 4, 0.437, 0.263)])
def test_groups_of_equal_size_at_the_stated_bounds(spark, sizes, inside, across):
    x = groups(sizes, inside, across, 0)
    members, _ = similarity_clusters(frame(spark, x), 400, join_similarity=0.39, min_size=5)
    assert {r["cell_id"]: r["cluster_id"] for r in members.collect()} == {i: i // 40 * 40 for i in range(len(x))}


def test_many_small_groups_beside_one_of_half_the_rows(spark, monkeypatch):
    """2,000 groups of five beside one of 10,000 rows, which is spread over tasks; fewer rows drawn per round than groups."""
    monkeypatch.setattr(clusters, "HOT_ROWS", 3_000)
    rng = np.random.default_rng(9)
    data, want = [], {}
    for g in range(2001):
        genes = np.sort(rng.choice(20_000, 40, False))
        base = rng.integers(20, 60, 40)
        first = len(data)
        for _ in range(5 if g else 10_000):
            want[len(data)] = first
            data.append((len(data), genes.tolist(), (base + rng.integers(-3, 4, 40)).astype(float).tolist(), "x"))
    df = spark.createDataFrame(data, "cell_id int, genes array<int>, counts array<float>, cluster_id string").repartition(8)
    members, described = similarity_clusters(df, 20_000, join_similarity=0.39, min_size=5, seeds=700)
    assert {r["cell_id"]: r["cluster_id"] for r in members.collect()} == want
    assert sorted(r["vertex_count"] for r in described.collect()) == [5] * 2000 + [10_000]


def test_no_row_is_left_by_the_rounds(spark):
    """More groups and loners than ten rounds draw rows."""
    x = groups((5,) * 6, 0.8, 0.1, 120)
    members, clusters = similarity_clusters(frame(spark, x), 400, join_similarity=0.39, min_size=1, seeds=12)
    want = {i: i // 5 * 5 if i < 30 else i for i in range(150)}
    assert {r["cell_id"]: r["cluster_id"] for r in members.collect()} == want
    assert sorted(r["vertex_count"] for r in clusters.collect()) == [1] * 120 + [5] * 6


def test_p1_groups_describes_small_groups(spark, monkeypatch):
    x = groups((5, 3, 2), 0.8, 0.1, 1)
    monkeypatch.setattr(queries_clusters, "cell_rows", lambda spark, d: (frame(spark, x), 400))
    got = {r["cluster_id"]: r["vertex_count"] for r in queries_clusters.p1_groups(spark, "").collect()}
    assert got == {0: 5, 5: 3, 8: 2, 10: 1}
    assert {r["cell_id"] for r in queries_clusters.p1_found(spark, "").collect()} == set(range(5))


def test_empty(spark):
    none = frame(spark, np.zeros((0, DIMS)))
    assert nearest_rows(none, DIMS, 5).count() == 0
    members, clusters = similarity_clusters(none, DIMS)
    assert members.count() == 0 == clusters.count()

import math
import random

import numpy as np
import pytest

from countgrid.operators import graphs, lsh, matrix, meta, sets, similarity
from countgrid.session import Scratch

N = 40


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = (rng.random((60, N)) < 0.3) * rng.integers(1, 20, (60, N))
    for i in range(0, 30, 3):  # related rows
        x[i + 1] = np.maximum(0, x[i] + rng.integers(-1, 2, N) * (x[i] > 0))
    x[59] = 0
    rows = [(int(c), int(g), float(x[c, g])) for c, g in zip(*np.nonzero(x))]
    return x.astype(float), spark.createDataFrame(rows, "cell_id int, gene_id int, count float").cache()


def pearson(x):
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.corrcoef(x)


@pytest.mark.parametrize("block", [(7, 3), (25, 1024), (8192, 10)])
def test_exact_pairs(data, block, monkeypatch):
    x, df = data
    monkeypatch.setattr(similarity.block_pairs, "__defaults__", (*block, None))
    got = {}
    for r in similarity.exact_pairs(df, N, 4, 0.1).collect():
        got.setdefault(r["id0"], []).append((r["rank"], r["id1"], r["similarity"]))
    s = pearson(x)
    for i in range(60):
        order = sorted((-round(s[i, j], 9), j) for j in range(60) if j != i and s[i, j] > 0.1)[:4]
        assert [j for _, j, _ in sorted(got.get(i, []))] == [j for _, j in order]


def test_pair_similarity_of_constant_rows_is_null(spark, data):
    x, df = data
    pairs = spark.createDataFrame([(0, 1), (0, 59)], "id0 int, id1 int")
    got = {r["id1"]: r["exact"] for r in similarity.pair_similarity(df, pairs, N).collect()}
    assert abs(got[1] - pearson(x)[0, 1]) < 1e-9 and got[59] is None


def test_signatures_estimate_the_similarity(spark, data):
    x, df = data
    bits = 1024
    sigs = lsh.signatures(df, N, bits).cache()
    s = pearson(x)
    pairs = {(r["id0"], r["id1"]): r["similarity"] for r in lsh.lsh_pairs_all(sigs, bits, 100, -0.99).collect()}
    errors = np.array([v - s[a, b] for (a, b), v in pairs.items()])
    theta = np.arccos(np.clip(np.array([s[a, b] for a, b in pairs]), -1, 1))
    p = 1 - theta / math.pi
    expected = math.pi * np.sin(theta) * np.sqrt(p * (1 - p) / bits)
    assert np.sqrt((errors**2).mean()) <= 1.5 * np.sqrt((expected**2).mean())
    high = {k: v for k, v in pairs.items() if v > 0.7}
    for found in (lsh.lsh_pairs_sliced(sigs, bits, 8, 0, 100, 0.7), lsh.lsh_pairs_multi_slice(sigs, bits, [12, 8], 60, 100, 0.7, True, 0), lsh.lsh_pairs_permuted(sigs, bits, 24, 10, 100, 0.7)):
        got = {(r["id0"], r["id1"]): r["similarity"] for r in found.collect()}
        assert set(got) <= set(high) and len(got) >= 0.95 * len(high) and all(abs(high[k] - v) < 1e-12 for k, v in got.items())
    counts = {r["bit"]: (r["set"], r["unset"]) for r in lsh.bit_counts(sigs, bits).collect()}
    assert len(counts) == bits and all(a + b == 59 for a, b in counts.values())
    text = sigs.select(lsh.text_bits(sigs.sig, bits).alias("t")).first()["t"]
    assert len(text) == bits and set(text) <= {"x", "_"}


def test_sliced_searches_keep_buckets_of_every_size(spark):
    """Copies (1,300 rows, above any bucket limit), near copies of them that share most slices, and rows apart."""
    rng = np.random.default_rng(5)
    base, bits, k = rng.random(64) < 0.5, 64, 4
    flags = [base] * 1300 + [base ^ (np.arange(64) == b) for b in range(40)] + [rng.random(64) < 0.5 for _ in range(60)]
    order = rng.permutation(len(flags))
    flags = np.array(flags)[order]
    words = np.packbits(flags, axis=1).view(">u8").astype(np.uint64).view(np.int64)
    sigs = spark.createDataFrame([(i, [int(w[0])]) for i, w in enumerate(words)], "id bigint, sig array<bigint>").cache()
    m = (flags[:, None, :] != flags[None, :, :]).sum(axis=2)
    share = (flags.reshape(-1, 1, 4, 16) == flags.reshape(1, -1, 4, 16)).all(axis=3).any(axis=2)
    near = np.where(share & (np.cos(np.pi * m / bits) > 0.5), m, 99)
    np.fill_diagonal(near, 99)
    best = np.argsort(near, axis=1, kind="stable")[:, :k]
    want = {(i, r + 1, int(j)) for i in range(len(near)) for r, j in enumerate(best[i]) if near[i, j] < 99}
    for overflow in (0, 10, 1000):  # by joins only, most buckets in blocks, as the queries do
        found = lsh.lsh_pairs_sliced(sigs, bits, 16, overflow, k, 0.5).collect()
        assert {(r["id0"], r["rank"], r["id1"]) for r in found} == want and len(found) == len(want)
        assert all(abs(r["similarity"] - math.cos(math.pi * m[r["id0"], r["id1"]] / bits)) < 1e-12 for r in found)
    multi = {(r["id0"], r["id1"]) for r in lsh.lsh_pairs_multi_slice(sigs, bits, [16], 30, k, 0.5).collect()}
    want = set()
    for i in range(len(flags)):
        seen = {}
        for part in range(4):
            same = (flags.reshape(-1, 4, 16)[:, part] == flags[i].reshape(4, 16)[part]).all(axis=1)
            seen |= dict.fromkeys(int(j) for j in np.nonzero(same)[0] if j != i and j not in seen)
        good = [(m[i, j], j) for j in list(seen)[:30] if m[i, j] < lsh.most_mismatches(0.5, bits)]
        want |= {(i, j) for _, j in sorted(good)[:k]}
    assert multi == want


def test_signatures_do_not_depend_on_the_partitioning(data):
    _, df = data
    a = {r["id"]: r["sig"] for r in lsh.signatures(df, N, 128).collect()}
    b = {r["id"]: r["sig"] for r in lsh.signatures(df.repartition(7), N, 128).collect()}
    assert a == b


def test_searches_do_not_depend_on_the_partitioning(spark, data):
    _, df = data
    sigs = lsh.signatures(df, N, 128, planes=lsh.md5_planes).cache()
    found = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            found.append({(r["id0"], r["rank"], r["id1"]) for r in lsh.lsh_pairs_permuted(sigs, 128, 6, 3, 5, 0.1).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and found[0]


def test_neighbours_in_order_reach_across_groups(spark, monkeypatch):
    monkeypatch.setattr(lsh, "SCAN_ROWS", 8)
    rows = [(i % 2, i // 3, 1000 - i) for i in range(90)]  # ties of the key are ordered by id
    placed = spark.createDataFrame(rows, "p int, key bigint, id bigint")
    got = {tuple(r) for r in lsh.neighbours_in_order(placed, 3, Scratch(spark, "test")).collect()}
    want = set()
    for p in (0, 1):
        ids = [i for _, _, i in sorted(r for r in rows if r[0] == p)]
        want |= {(a, b) for x, a in enumerate(ids) for y, b in enumerate(ids) if 0 < abs(x - y) <= 3}
    assert got == want


def test_error_bins_of_all_pairs(spark, data):
    x, df = data
    bits = 256
    sigs = lsh.signatures(df, N, bits).cache()
    estimate = {(r["id0"], r["id1"]): r["similarity"] for r in lsh.lsh_pairs_all(sigs, bits, 100, -1.0, True).collect()}
    bins = {}
    s = pearson(x).round(9)
    for i in range(59):
        for j in range(i + 1, 59):
            bins.setdefault(min(199, math.floor((s[i, j] + 1) / 0.01)), []).append(estimate[i, j] - s[i, j])
    got = {r["bin"]: r for r in lsh.error_bins_of_all(df, sigs, N, bits).collect()}
    assert {b: len(d) for b, d in bins.items() if len(d) > 1} == {b: r["n"] for b, r in got.items()}
    assert all(abs(r["bias"] - np.mean(bins[b])) < 1e-9 and abs(r["rms"] - np.sqrt(np.mean(np.square(bins[b])))) < 1e-9 for b, r in got.items())


def test_common_prefix(spark):
    rows = [([1, 2], [1, 2], 128), ([1, 2], [1, 3], 127), ([-1, 0], [1, 0], 0), ([4, 0], [6, 0], 62), ([0, -1], [0, 1], 64)]
    got = spark.createDataFrame(rows, "sig0 array<bigint>, sig1 array<bigint>, want int").select(lsh.common_prefix().alias("n"), "want").collect()
    assert all(r["n"] == r["want"] for r in got)


def test_hashed_buckets_only_add_candidates(spark, data):
    _, df = data
    sigs = lsh.signatures(df, N, 128).cache()
    plain, few = ({(r["id0"], r["id1"]) for r in lsh.lsh_pairs_multi_slice(sigs, 128, [16, 8], 1000, 100, 0.3, log2_buckets=b).collect()} for b in (0, 3))
    assert plain < few


def test_threshold_in_bits():
    for t in (0.2, 0.5, 1.0, -0.5):
        m = lsh.most_mismatches(t, 64)
        assert math.cos(m * math.pi / 64) >= t > math.cos((m + 1) * math.pi / 64)
    with pytest.raises(ValueError):
        lsh.most_mismatches(1.5, 64)


def test_signature_graph(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(-8, 8)]) for i in range(200)]
    sigs = spark.createDataFrame(rows, "id bigint, sig array<bigint>")
    vertices, edges = graphs.signature_graph(sigs, 64, 3)
    got = sorted(map(tuple, edges.collect()))
    own = {r["id"]: r["sig"][0] & (2**64 - 1) for r in vertices.collect()}
    assert got == sorted((a, b) for a in own for b in own if a < b and (own[a] ^ own[b]).bit_count() == 1) and got


def test_knn_graph(spark):
    pairs = [(0, 1, 0.9), (1, 0, 0.9), (0, 2, 0.8), (0, 3, 0.7), (0, 9, 0.99), (4, 4, 1.0), (2, 3, 0.4), (3, 0, 0.75)]
    df = spark.createDataFrame(pairs, "id0 bigint, id1 bigint, similarity double")
    members = spark.createDataFrame([(i,) for i in range(5)], "id bigint")
    vertices, edges = graphs.knn_graph(df, members, 0.5, 2)
    assert sorted(map(tuple, edges.collect())) == [(0, 1, 0.9), (0, 2, 0.8), (0, 3, 0.75)]
    assert sorted(r["id"] for r in vertices.collect()) == [0, 1, 2, 3]
    assert graphs.knn_graph(df, members, 0.5, 2, True)[0].count() == 5
    row = graphs.compare_graphs(vertices, edges, *graphs.knn_graph(df, members, 0.78, 2)).first()
    assert (row["common_vertices"], row["edges0"], row["edges1"], row["common_edges"], row["equal_edges"]) == (3, 3, 2, 2, 2)


def test_label_propagation_finds_planted_parts_and_components(spark):
    rng = random.Random(3)
    part = {i: i // 12 for i in range(36)}
    edges = [(a, b, 0.9) for a in part for b in part if a < b and part[a] == part[b] and rng.random() < 0.6] + [(0, 12, 0.5), (13, 24, 0.5)]
    e = spark.createDataFrame(edges, "src bigint, dst bigint, similarity double")
    v = spark.createDataFrame([(i,) for i in part], "id bigint")
    labels = {r["id"]: r["cluster_id"] for r in graphs.label_propagation(v, e, max_iterations=30).collect()}
    assert len(set(labels.values())) == 3 and all(labels[a] == labels[b] for a, b, s in edges if s == 0.9)
    parts = {r["id"]: r["component"] for r in graphs.components(v, e.filter("similarity > 0.6")).collect()}
    assert len(set(parts.values())) == 3 and all(parts[i] == min(j for j in part if part[j] == part[i]) for i in part)
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(35)], "src bigint, dst bigint, similarity double")
    assert {r["component"] for r in graphs.components(v, chain).collect()} == {0}


def test_colors(spark):
    v = spark.createDataFrame([(i,) for i in range(4)], "id bigint")
    numbers = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "id bigint, value double")
    assert {r["id"]: r["color"] for r in graphs.scale_colors(v, numbers).collect()} == {0: "#ff0000", 1: "#ffff00", 2: "#00ff00", 3: "#000000"}
    groups = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "")], "id bigint, value string")
    got = {r["id"]: r["color"] for r in graphs.category_colors(v, groups).collect()}
    assert got[0] == got[2] == graphs.CATEGORY_COLORS[0] and got[1] == graphs.CATEGORY_COLORS[1] and got[3] == "#000000"
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 3, 1.0)], "src bigint, dst bigint, similarity double")
    assert graphs.greedy_group_colors(edges, groups) == {"a": 0, "": 0, "b": 1}


def test_meta_and_sets(spark):
    rows = [(0, "f", "1", 0), (0, "g", "x", 1), (1, "f", " 2", 0), (2, "f", "2e0", 0), (3, "f", "12f", 0), (4, "f", "nan", 0)]
    m = spark.createDataFrame(rows, "cell_id int, name string, value string, ord int")
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(sets.cells_by_number(m, "f", 1, 2)) == [0, 2] and ids(sets.cells_by_regex(m, "f", "2.*")) == [2]
    up = meta.upsert(m, spark.createDataFrame([(0, "f", "9"), (0, "h", "new"), (7, "f", "0")], "cell_id int, name string, value string"))
    got = {(r["cell_id"], r["name"]): (r["value"], r["ord"]) for r in up.collect()}
    assert got[0, "f"] == ("9", 0) and got[0, "h"] == ("new", 2) and got[7, "f"] == ("0", 0) and len(got) == 8
    cells = spark.createDataFrame([(i,) for i in range(2000)], "cell_id int")
    sample = ids(sets.downsample(cells, 0.3, 1))
    assert sample == ids(sets.downsample(cells.repartition(5), 0.3, 1)) and 500 < len(sample) < 700
    a, b = sets.downsample(cells, 0.5, 2), sets.downsample(cells, 0.5, 3)
    assert sets.same_members(sets.difference(a, b), sets.difference(a, sets.intersection([a, b])))
    assert sets.content_hash(a, "cell_id") == sets.content_hash(a.orderBy("cell_id", ascending=False), "cell_id") != sets.content_hash(b, "cell_id")
    assert len(sets.downsample_stream(list(range(1000)), 0.25, 5)) in range(200, 300)


def test_empty_matrix(spark):
    none = spark.createDataFrame([], "cell_id int, gene_id int, count float")
    cells, genes = none.select("cell_id"), none.select("gene_id")
    assert similarity.exact_pairs(none, N).count() == 0 and lsh.signatures(none, N).count() == 0
    assert matrix.information_content(none, genes, cells).count() == 0 and matrix.cell_sums(none).count() == 0
    v, e = graphs.knn_graph(spark.createDataFrame([], "id0 bigint, id1 bigint, similarity double"), spark.createDataFrame([], "id bigint"))
    assert graphs.label_propagation(v, e, max_iterations=2, stable_iterations=1).count() == 0 and graphs.components(v, e).count() == 0

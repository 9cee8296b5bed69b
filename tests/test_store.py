import json
import math

import numpy as np
import pytest

from countgrid.sources.delimited import tokenize
from countgrid.store import MatrixStore
from countgrid.streaming.ingest import read_json_lines, start_ingest


def close(a, b):
    return abs(a - b) < 1e-6


@pytest.fixture(scope="module")
def toy1(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("toy1")
    (d / "counts.csv").write_text("x,Cell0,Cell1,Cell2\r\nGene0,10,0,0\r\nGene1,10,10,0\r\nGene3,0,10,20\r\n")
    (d / "meta.csv").write_text("Cell;Organ;Tumor\nCell0;brain;yes\nCell1;\"li\\nver\";no\nCell2;brain;no\n")
    store = MatrixStore(spark, str(d / "store"))
    store.add_cells(str(d / "counts.csv"), ",", str(d / "meta.csv"), ";", [("Batch", "b1")])
    return store, d


def test_tokenizer():
    assert tokenize('a, "b,c" ;d\\,e,', ",;") == ["a", "b,c", "d,e", ""]
    assert tokenize(" a\tb ", "\t", trim=False) == [" a", "b "]
    with pytest.raises(ValueError):
        tokenize("a\\")


def test_ingest_and_lookups(toy1):
    store, _ = toy1
    assert store.summary() == {"genes": 3, "cells": 3, "counts": 5}
    assert store.gene_name(2) == "Gene3" and store.gene_id_from_name("nope") is None
    assert store.cell_id_from_string("2") == 2 == store.cell_id_from_string("Cell2") and store.cell_id_from_string("9") is None
    assert [(r["name"], r["value"]) for r in store.get_cell_meta_data(1).collect()] == [("CellName", "Cell1"), ("Batch", "b1"), ("Organ", "li\nver"), ("Tumor", "no")]
    assert store.get_cell_meta_data_value(0, "Organ") == "brain" and store.get_cell_meta_data_value(0, "x") == ""
    assert store.get_cell_expression_count(0, "Gene3") == 0 and store.get_cell_expression_count(2, 2) == 20
    assert [r["count"] for r in store.get_cells_expression_count([2, 0, 2], "Gene3").collect()] == [20, 0, 20]
    assert [[tuple(c) for c in r["counts"]] for r in store.get_cells_expression_counts([1, 0], [1]).collect()] == [[(1, 10.0)], [(1, 10.0)]]
    assert {r["cell_id"]: r["expression"] for r in store.get_dense_expression_matrix().collect()} == {0: [10, 10, 0], 1: [0, 10, 10], 2: [0, 0, 20]}
    again = MatrixStore(store.spark, store.path, read_only=True)
    assert again.cell_count() == 3
    with pytest.raises(PermissionError):
        again.add_gene("new")


def test_similar_pairs_and_information(toy1):
    store, _ = toy1
    assert [close(store.compute_cell_similarity(a, b), s) for a, b, s in ((0, 1, -0.5), (0, 2, -1.0), (1, 2, 0.5))] == [True] * 3
    store.find_similar_pairs0("exact")
    assert [(r["id0"], r["id1"], round(r["similarity"], 6)) for r in store.similar_pairs("exact").orderBy("id0").collect()] == [(1, 2, 0.5), (2, 1, 0.5)]
    bits = {r["gene_id"]: r["information_content"] for r in store.gene_information_content().collect()}
    assert all(close(bits[g], v) for g, v in enumerate((1.584963, 0.584963, 0.666667)))
    bits = {r["gene_id"]: r["information_content"] for r in store.gene_information_content(normalization="L2").collect()}
    assert all(close(bits[g], v) for g, v in enumerate((1.584963, 0.584963, 0.606302)))
    store.create_gene_set_using_information_content("high", threshold=0.6)
    assert sorted(r[0] for r in store.gene_set("high").collect()) == [0, 2]
    store.find_similar_pairs4("lsh", threshold=0.2)
    assert [(r["id0"], r["id1"]) for r in store.similar_pairs("lsh").orderBy("id0").collect()] == [(1, 2), (2, 1)]
    assert abs(store.similar_pairs("lsh").first()["similarity"] - 0.5) < 0.12
    assert store.get_similar_pairs_names() == ["exact", "lsh"]
    assert store.compare_similar_pairs("exact", "lsh").count() == 2
    store.write_similar_pairs("exact", str(toy1[1] / "pairs"))
    assert sorted(map(tuple, store.spark.read.option("header", True).csv(str(toy1[1] / "pairs")).select("Cell0", "Cell1").collect())) == [("Cell1", "Cell2"), ("Cell2", "Cell1")]
    assert store.gene_sets_of_similar_pairs("exact") == ["AllGenes"]
    store.compute_lsh_signatures("sig", lsh_count=256)
    assert store.get_lsh_names() == ["sig"] and store.analyze_lsh("sig").count() == 0  # three pairs, each alone in its bin
    assert [df.count() for df in store.analyze_lsh_signatures("sig")] == [3, 1, 256]
    store.create_cell_graph("graph", "exact", threshold=0.4)
    assert {r["color"] for r in store.colored_cell_graph("graph", "Organ").collect()} == {"#1f78b4", "#33a02c"}
    store.write_graph("cell_graph", "graph", str(toy1[1] / "dot"))
    text = "\n".join(r[0] for r in store.spark.read.text(str(toy1[1] / "dot")).collect())
    assert text.startswith("graph G {") and '  1 -- 2 [weight="0.500000"];' in text and text.endswith("}")
    assert store.compare_cell_graphs("graph", "graph")[0].first()["equal_edges"] == 1
    vertices, edges = store.graph("cell_graph", "graph")
    assert sorted(r["id"] for r in vertices.collect()) == [1, 2] and edges.count() == 1
    store.create_cluster_graph("graph", "clusters", min_cluster_size=1, max_iterations=5)
    store.create_meta_data_from_cluster_graph("clusters", "Cluster")
    assert store.get_cell_meta_data_value(1, "Cluster") == "0" and store.get_cell_meta_data_value(0, "Cluster") == ""
    average = {r["gene_id"]: r["average"] for r in store.get_cluster_average_expression("clusters", 0).collect()}
    assert close(sum(v * v for v in average.values()), 1)
    with pytest.raises(ValueError):
        store.find_similar_pairs0("exact")
    store.remove_similar_pairs("lsh")
    store.remove_cluster_graph("clusters")
    assert store.get_similar_pairs_names() == ["exact"] and store.table("profiles").count() == 0


def test_sets(toy1):
    store, _ = toy1
    store.create_cell_set_using_meta_data("brain", "Organ", "brain")
    store.create_cell_set_using_meta_data("no", "Tumor", "n.", use_regex=True)
    store.create_cell_set_union("u", ["brain", "no"])
    store.create_cell_set_intersection("i", ["brain", "no"])
    store.create_cell_set_difference("d", "AllCells", "brain")
    members = lambda n: sorted(r[0] for r in store.cell_set(n).collect())
    assert [members(n) for n in ("brain", "no", "u", "i", "d")] == [[0, 2], [1, 2], [0, 1, 2], [2], [1]]
    assert store.get_cell_set_names() == ["AllCells", "brain", "d", "i", "no", "u"]
    rand, adjusted = store.compute_meta_data_rand_index("AllCells", "Organ", "Tumor")
    assert close(rand, 1 / 3) and close(adjusted, -0.5)
    assert [(r["value"], r["n"]) for r in store.meta_data_histogram("Organ").collect()] == [("brain", 2), ("li\nver", 1)]
    for call in (lambda: store.create_cell_set_union("u", ["brain"]), lambda: store.create_cell_set_union("z", ["none"]), lambda: store.remove_cell_set("AllCells"), lambda: store.create_cell_set("q", [77])):
        with pytest.raises((ValueError, KeyError)):
            call()
    store.create_gene_set_from_gene_names("named", "Gene0, Gene3")
    with pytest.raises(ValueError):
        store.create_gene_set_from_gene_names("bad", ["Gene0", "zzz"])
    store.create_well_expressed_gene_set("well", min_cell_count=2)
    assert sorted(r[0] for r in store.gene_set("well").collect()) == [1, 2]


def test_json_cells_and_stream(spark, tmp_path):
    store = MatrixStore(spark, str(tmp_path / "store"))
    cells = [({"CellName": "cell0", "Type": "a"}, {"gene1": 10, "gene2": 20}), ({"CellName": "cell1"}, {"gene1": 30, "gene9": 0})]
    store.add_cell_from_json(json.dumps({"metaData": cells[0][0], "expressionCounts": cells[0][1]}))
    assert store.add_cell(list(cells[1][0].items()), list(cells[1][1].items())) == 1
    (tmp_path / "in").mkdir()
    lines = [{"metaData": {"CellName": "cell2"}, "expressionCounts": {"gene2": 40}}, {"metaData": {"CellName": "cell1"}, "expressionCounts": {"gene1": 99}}]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    start_ingest(store, read_json_lines(spark, str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination(120)
    assert store.cell_count() == 3 and store.gene_count() == 3  # gene9 is registered though its count is 0
    exact = [store.compute_cell_similarity(a, b, "AllGenes") for a, b in ((0, 1), (0, 2), (1, 2))]
    assert all(s is not None and math.isfinite(s) for s in exact) and store.get_cell_expression_count(1, "gene1") == 30
    for meta, counts in (({"x": "1"}, {}), ({"CellName": "cell0"}, {"g": 1}), ({"CellName": "n"}, {"g": -1}), ({"CellName": "n"}, [("g", 1), ("g", 2)])):
        with pytest.raises(ValueError):
            store.add_cell(meta, counts)
    assert store.cell_count() == 3


def test_other_loaders(spark, tmp_path):
    (tmp_path / "counts.txt").write_text("red blue green\nBob 20 1 0\nJim 0 1 0\nSteve 20 1 60\n")
    (tmp_path / "meta.txt").write_text("name Size\ngreen 1\nred 2\nblack 3\n")
    store = MatrixStore(spark, str(tmp_path / "s"))
    store.add_cells(str(tmp_path / "counts.txt"), " ", str(tmp_path / "meta.txt"), " ")
    assert [r["cell_name"] for r in store.table("cells").orderBy("cell_id").collect()] == ["red", "green"] and store.gene_count() == 3
    assert close(store.compute_cell_similarity(0, 1), 0.5)
    bits = {r["gene_id"]: r["information_content"] for r in store.gene_information_content().collect()}
    assert close(bits[0], 1.0) and close(bits[1], 1.0) and close(bits[2], 0.188722)
    (tmp_path / "more.csv").write_text("cell,Size\nred,7\ngreen,8\n")
    store.add_cell_meta_data(str(tmp_path / "more.csv"))
    assert store.get_cell_meta_data_value(0, "Size") == "7"
    (tmp_path / "P1.x.csv").write_text("cell,pre,G1,G2,post\nq1,a,1,0,z\nq2,b,0,3,y\n")
    (tmp_path / "plates.csv").write_text("plate,Mouse\nP1,m7\n")
    store.add_cells_by_row(str(tmp_path / "P1.x.csv"), 1, 1, str(tmp_path / "plates.csv"))
    q2 = store.cell_id_from_string("q2")
    assert store.get_cell_expression_count(q2, "G2") == 3 and store.get_cell_meta_data_value(q2, "Mouse") == "m7" and store.get_cell_meta_data_value(q2, "post") == "y"
    (tmp_path / "plain.csv").write_text("x,r1,r2\nG1,5,0\nUnused,0,0\n")
    store.add_cells_without_meta(str(tmp_path / "plain.csv"), ",", [("Kind", "k")])
    assert store.gene_id_from_name("Unused") is None and store.get_cell_meta_data_value(store.cell_id_from_string("r2"), "Kind") == "k"
    for name, text in (("a", "x,c1\nG1,1\nG1,2\n"), ("b", "x,c1\nG1,one\n"), ("c", "x,c1\nG1,-1\n"), ("d", "x,c1\nG1,1,2\nG2,1\n"), ("e", "x,red\nG1,1\n")):
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(Exception):
            store.add_cells_without_meta(str(tmp_path / f"{name}.csv"))
    assert store.cell_count() == 6


def arrays():
    """A stand-in for an HDF5 file, one group of arrays in an .npz file; made here so that workers get it by value."""

    class Arrays:
        def __init__(self, path):
            self.group = dict(np.load(path))

        def __enter__(self):
            return self

        def __exit__(self, *error):
            return False

        def keys(self):
            return ["matrix"]

        def __getitem__(self, name):
            return self.group

    return Arrays


def matrix_file(path, barcodes, genes, rows):
    indptr = np.cumsum([0, *map(len, rows)])
    flat = [p for r in rows for p in r]
    np.savez(path, barcodes=np.array(barcodes, "S"), genes=np.array(genes, "S"), indptr=indptr, indices=np.array([g for g, _ in flat], np.int64), data=np.array([c for _, c in flat], np.int64))
    return str(path)


def test_matrices_of_plates(spark, tmp_path):
    """Cells without counts are kept, in the order of the barcodes, and a threshold leaves cells out."""
    one = matrix_file(tmp_path / "one.npz", ["Z", "E", "A"], ["g0", "g1", "g2"], [[(1, 5)], [], [(0, 1), (2, 3)]])
    two = matrix_file(tmp_path / "two.npz", ["Z", "B"], ["g2", "g9"], [[(0, 2)], [(1, 8)]])
    store = MatrixStore(spark, str(tmp_path / "s"))
    store.add_cells_from_hdf5(one, "p", opener=arrays())
    assert [r["cell_name"] for r in store.table("cells").orderBy("cell_id").collect()] == ["p-Z", "p-E", "p-A"]
    assert sorted(map(tuple, store.table("counts").collect())) == [(0, 1, 5.0), (2, 0, 1.0), (2, 2, 3.0)]
    (tmp_path / "plates.csv").write_text(f"PlateName,aws-s3-hdf5,Donor\nq1,{one},d1\nq2,{two},d2\n")
    store.add_cells_of_plates(str(tmp_path / "plates.csv"), min_total=3, opener=arrays())
    assert [r["cell_name"] for r in store.table("cells").orderBy("cell_id").collect()][3:] == ["q1-Z", "q1-A", "q2-B"]
    assert store.get_cell_meta_data_value(5, "Donor") == "d2" and store.get_cell_expression_count(5, "g9") == 8 and store.gene_count() == 4
    with pytest.raises(Exception):
        store.add_cells_from_hdf5(matrix_file(tmp_path / "bad.npz", ["a"], ["g", "g"], [[]]), opener=arrays())


def size_of(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_adding_writes_only_new_rows_and_a_failed_change_leaves_the_store(spark, tmp_path, monkeypatch):
    store = MatrixStore(spark, str(tmp_path / "s"))
    rng = np.random.default_rng(1)
    large = [({"CellName": f"a{i}"}, {f"g{int(g)}": float(rng.integers(1, 10**6)) for g in rng.choice(400, 40, False)}) for i in range(200)]
    store.add_cell_batch(large)
    before = size_of(tmp_path / "s")
    files = set((tmp_path / "s").rglob("*.parquet"))
    store.add_cell_batch([({"CellName": "b"}, {"g1": 1.0, "new": 2.0})])
    assert size_of(tmp_path / "s") - before < before / 3 and files < set((tmp_path / "s").rglob("*.parquet"))
    assert store.cell_count() == 201 and store.cell_id_from_string("b") == 200 and store.gene_id_from_name("new") == store.gene_count() - 1
    # all is written but the manifest
    with monkeypatch.context() as broken:
        broken.setattr(MatrixStore, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.add_cell_batch([({"CellName": "c"}, {"g1": 1.0})])
    assert store.cell_count() == 201 == MatrixStore(spark, store.path).cell_count()
    other = MatrixStore(spark, store.path)
    store.add_cell_batch([({"CellName": "c"}, {"g1": 1.0})])
    with pytest.raises(RuntimeError):  # a writer that doesn't know the newest version
        other.add_gene("x")
    counts = sorted(map(tuple, store.table("counts").collect()))
    store.compact()
    assert len(store._parts["counts"]) == 1 and store.vacuum() > 5
    assert sorted(map(tuple, MatrixStore(spark, store.path).table("counts").collect())) == counts and store.cell_count() == 202


def test_graph_colors_layout_and_lists(spark, tmp_path):
    store = MatrixStore(spark, str(tmp_path / "s"))
    store.add_cells_from_texts("x,a,b,c\nG0,5,4,0\nG1,1,2,9\nG2,0,1,7\n", ",", "c,Kind,Col\na,k1,#ff0000\nb,k2,blue\nc,k1,?\n", ",")
    store.find_similar_pairs0("p", threshold=-0.99)
    store.create_cell_graph("g", "p", threshold=0.1)
    with pytest.raises(ValueError):
        store.get_cell_graph_vertices("g")
    store.compute_cell_graph_layout("g")
    assert sorted(r["id"] for r in store.get_cell_graph_vertices("g").collect()) == [0, 1]
    assert {r["id"]: r["color"] for r in store.colored_cell_graph("g", "Col", as_color=True).collect()} == {0: "#ff0000", 1: "blue"}
    assert {r["id"]: r["color"] for r in store.cell_graph_colored_by_gene("g", "G0", "none").collect()} == {0: "#00ff00", 1: "#ff0000"}
    assert store.cell_graph_colored_by_similarity("g", 0).filter("id = 1").first()["value"] > 0.8
    store.write_svg("g", str(tmp_path / "svg"), "Kind")
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "svg")).collect())
    assert text.startswith("<svg") and text.count("<circle") == 2 and text.count("<line") == 1 and text.endswith("</svg>")
    store.store_cluster_id("g", "Part", max_iterations=3)
    assert store.get_cell_meta_data_value(0, "Part") == "0"
    store.create_cell_set("two", [0, 1])
    assert {r["set_name"]: r["n"] for r in store.cell_set_sizes().collect()} == {"AllCells": 3, "two": 2}
    store.create_cluster_graph("g", "cg", min_cluster_size=1, max_iterations=2)
    assert [r[0] for r in store.get_cluster_graph_genes("cg").collect()] == [0, 1, 2] and store.get_cluster_graph_names() == ["cg"]
    store.find_similar_gene_pairs0("gp", k=2, threshold=-0.99)
    store.write_similar_gene_pairs("gp", str(tmp_path / "gp"))
    rows = [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "gp")).collect()]
    assert rows and {(b, a, s) for a, b, s in rows} == set(rows)
    store.compute_lsh_signatures("s", lsh_count=8)
    store.create_signature_graph("sg", "s", 1)
    shares = {}
    for r in store.signature_graph_shares("sg", "Kind").collect():
        shares[r["id"]] = shares.get(r["id"], 0) + r["fraction"]
    assert all(close(v, 1) for v in shares.values())
    assert [tuple(r) for r in store.listing().collect()] == [("cell_graph", "g"), ("cell_set", "two"), ("cluster_graph", "cg"), ("signature_graph", "sg"), ("signatures", "s"), ("similar_gene_pairs", "gp"), ("similar_pairs", "p")]
    assert 0 <= store.sample_similar_pairs("p", 0.5).count() <= store.similar_pairs("p").count()

"""The store's queries make only what they read."""

from countgrid.plans import store_queries
from countgrid.store import MatrixStore

DATA = "/root/testdata/sf0.001"


def test_cluster_profile_makes_no_gene_pairs_and_no_fields(spark, monkeypatch):
    monkeypatch.setattr(store_queries, "_STORES", {})
    assert store_queries.store_cluster_profile(spark, DATA).count() > 0
    store = store_queries.csv_store(spark, DATA)
    assert store.get_similar_gene_pairs_names() == [] and store.table("cell_meta").filter("name = 'Cluster'").isEmpty()
    assert store_queries.store_cluster_cells(spark, DATA).count() > 0
    assert store_queries.store_gene_pairs_csv(spark, DATA).count() > 0


def test_expression_lists_reach_genes_beyond_the_usual_number(spark, tmp_path, monkeypatch):
    store = MatrixStore(spark, f"{tmp_path}/store")
    counts = [{f"g{g}": g + c + 1.0 for g in range(1508)} for c in range(2)]
    store.add_cell_batch([({"CellName": f"c{c}"}, own) for c, own in enumerate(counts)])
    monkeypatch.setattr(store_queries, "csv_store", lambda spark, d: store)
    rows = store_queries.store_expression_lists(spark, DATA).collect()
    assert sorted(map(tuple, rows)) == [(c, g, g + c + 1.0) for c in range(2) for g in range(1508) if g % 3 == 0]

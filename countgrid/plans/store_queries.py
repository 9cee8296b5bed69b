"""The store's own loaders, look-ups, sets, sinks and reports over files written from the whole tables, with SQL counterparts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countgrid.operators import meta
from countgrid.operators.pivot import latest_values
from countgrid.plans.matrix_queries import _C, _E, _S, cells_of, counts_of, genes_of, r6
from countgrid.session import Scratch, read_table, shuffle_partitions
from countgrid.store import MatrixStore
from countgrid.streaming.ingest import event_counts, read_json_lines, start_ingest

#: Lines of a table file that a task writes at once.
LINES_AT_ONCE = 32

_STORES: dict[tuple[str, str, str], MatrixStore] = {}


def _cached(kind: str, spark: SparkSession, d: str, make) -> MatrixStore:
    """A store of each kind per application and folder: queries only add objects of their own names."""
    key = (kind, spark.sparkContext.applicationId, d)
    if key not in _STORES:
        scratch = Scratch(spark, kind)
        store = MatrixStore(spark, f"{scratch.root}/store")
        make(store, scratch.root)
        _STORES[key] = store
    return _STORES[key]


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _in_order(lines: DataFrame) -> DataFrame:
    """Rows in the order of their ``place``, over as many tasks as shuffles have."""
    return lines.repartitionByRange(shuffle_partitions(lines.sparkSession), "place").sortWithinPartitions("place")


def _write_lines(lines: DataFrame, path: str) -> str:
    """``place, line`` as text files, whose names are in the order of the lines."""
    _in_order(lines).select("line").write.text(path)
    return path


def _write_dense(counts: DataFrame, rows: DataFrame, columns: DataFrame, path: str, last: str = "", ends: Column | None = None) -> str:
    """A table file, zeros included, each line as long as there are columns. ``rows``: id, label; ``columns``: id, label; ``counts``: row, column, count.

    Its header ends with ``last``, its lines with ``ends``. Only the counts travel, each as a row, to the lines' order;
    the zeros are written by the tasks that write the lines. A row of ``position`` -1 begins each line.
    """
    names = columns.agg(F.sort_array(F.collect_list(F.struct("id", "label"))).alias("names"))
    places = names.select(F.posexplode("names").alias("position", "c")).select("position", F.col("c.id").alias("column"))
    number = F.when(F.col("count") == 0, "0").otherwise(F.col("count").cast("double").cast("string"))
    own = counts.join(places, "column").select(F.col("row").cast("bigint").alias("place"), "position", number.alias("text"), F.lit("").alias("end"))
    starts = rows.select(F.col("id").cast("bigint").alias("place"), F.lit(-1).alias("position"), _quoted(F.col("label")).alias("text"), (F.lit("") if ends is None else ends).alias("end"))
    titles = F.array_join(F.transform("names", lambda c: _quoted(c["label"])), ",")
    head = names.select(F.lit(-1).cast("bigint").alias("place"), F.lit(-1).alias("position"), F.concat(F.lit("name,"), titles).alias("text"), F.lit(last).alias("end"))
    width = columns.count()

    def line(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, begun, fields, out = None, [], [], []
        for frame in frames:
            of, at = frame.column(0).to_numpy(), frame.column(1).to_numpy()
            cuts = [0, *(np.nonzero(np.diff(of))[0] + 1).tolist(), len(of)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                if of[low] != place:
                    out += [",".join([start, *fields]) + end for start, end in begun]
                    if len(out) >= LINES_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["line"])
                        out = []
                    place, begun, fields = of[low], [], ["0"] * width if of[low] >= 0 else []
                first = low + np.count_nonzero(at[low:high] < 0)
                begun += zip(*(frame.column(c).slice(low, first - low).to_pylist() for c in (2, 3)))
                for c, text in zip(at[first:high].tolist(), frame.column(2).slice(first, high - first).to_pylist()):
                    fields[c] = text
        out += [",".join([start, *fields]) + end for start, end in begun]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["line"])

    every = head.unionByName(starts).unionByName(own).repartitionByRange(shuffle_partitions(counts.sparkSession), "place")
    every.sortWithinPartitions("place", "position").mapInArrow(line, "line string").write.text(path)
    return path


def _fields_of(spark, d) -> DataFrame:
    """``cell_id, name, value`` by field names in lower case without outer blanks."""
    rows = latest_values(read_table(spark, d, "cell_meta_data"), "cell_id", "meta_name", "meta_value", ["loaded_at", "ord"])
    return rows.select(F.col("entity_id").alias("cell_id"), F.col("field").alias("name"), "value").filter("name != 'cellname' AND value IS NOT NULL")


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    cells = cells_of(spark, d).select(F.col("cell_id").alias("id"), F.col("cell_name").alias("label"))
    return cells, genes_of(spark, d).select(F.col("gene_id").alias("id"), F.col("gene_name").alias("label"))


def csv_store(spark: SparkSession, d: str) -> MatrixStore:
    """All cells from a genes-by-cells file and a meta data file."""

    def make(store: MatrixStore, root: str) -> None:
        cells, genes = _sides(spark, d)
        counts = counts_of(spark, d).select(F.col("gene_id").alias("row"), F.col("cell_id").alias("column"), "count")
        table = _write_dense(counts, genes, cells, f"{root}/counts.csv")
        fields = _fields_of(spark, d)
        names = sorted(r[0] for r in fields.select("name").distinct().collect())
        wide = meta.pivot_fields(fields, cells.select(F.col("id").alias("cell_id")), names).join(cells, F.col("cell_id") == F.col("id"))
        lines = wide.select(F.col("id").cast("bigint").alias("place"), F.concat_ws(";", _quoted(F.col("label")), *[_quoted(F.col(f"`{n}`")) for n in names]).alias("line"))
        head = spark.createDataFrame([(-1, ";".join(["cell", *names]))], "place bigint, line string")
        store.add_cells(table, ",", _write_lines(head.unionByName(lines), f"{root}/meta.csv"), ";", [("Source", "csv")])

    return _cached("csv", spark, d, make)


def _json_lines(spark, d) -> DataFrame:
    cells, genes = _sides(spark, d)
    counts = counts_of(spark, d).join(genes, F.col("gene_id") == genes.id).groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("label", F.col("count").cast("double")))).alias("expressionCounts"))
    plates = cells_of(spark, d).select("cell_id", "cell_name", F.create_map(F.lit("CellName"), F.col("cell_name"), F.lit("Plate"), F.coalesce("plate_name", F.lit(""))).alias("metaData"))
    none = F.create_map().cast("map<string,double>")
    return plates.join(counts, "cell_id", "left").select(F.to_json(F.struct("metaData", F.coalesce("expressionCounts", none).alias("expressionCounts"))).alias("value"))


def store_counts(spark, d):
    return csv_store(spark, d).table("counts").select("cell_id", "gene_id", F.col("count").cast("double").alias("count"))


def store_names(spark, d):
    """The dictionaries of cells and genes, with the names that their meta data hold."""
    store = csv_store(spark, d)
    cells = store.table("cells").join(store.table("cell_meta").filter("name = 'CellName'"), "cell_id")
    genes = store.table("genes").join(store.table("gene_meta").filter("name = 'GeneName'"), "gene_id")
    return cells.select(F.lit("cell").alias("kind"), F.col("cell_id").alias("id"), "cell_name", "value").unionAll(genes.select(F.lit("gene"), "gene_id", "gene_name", "value")).toDF("kind", "id", "name", "value")


def store_meta(spark, d):
    return csv_store(spark, d).table("cell_meta").filter("name NOT IN ('CellName', 'Plate', 'Copy', 'Cluster')").select("cell_id", "name", "value")


def store_json_cells(spark, d):
    """Cells from JSON lines, added by a stream."""

    def make(store: MatrixStore, root: str) -> None:
        _json_lines(spark, d).write.text(f"{root}/lines")
        start_ingest(store, read_json_lines(spark, f"{root}/lines"), f"{root}/checkpoint").awaitTermination()

    store = _cached("json", spark, d, make)
    counts = store.table("counts").join(store.table("cells"), "cell_id").join(store.table("genes"), "gene_id")
    return counts.select("cell_name", "gene_name", F.col("count").cast("double").alias("count"))


def store_rows_by_cell(spark, d):
    """Cells from a file of one line per cell, with fields of their plate from a second file."""

    def make(store: MatrixStore, root: str) -> None:
        cells, genes = _sides(spark, d)
        counts = counts_of(spark, d).select(F.col("cell_id").alias("row"), F.col("gene_id").alias("column"), "count")
        table = _write_dense(counts, cells, genes, f"{root}/P7.csv", ",last", F.concat(F.lit(",z"), "id"))
        plates = spark.createDataFrame([(0, "plate,Mouse"), (1, "P7,m7"), (2, "P8,m8")], "place int, line string")
        store.add_cells_by_row(table, 0, 1, _write_lines(plates, f"{root}/plates"), "P7")

    store = _cached("by-row", spark, d, make)
    sums = store.table("counts").groupBy("cell_id").agg(F.count(F.lit(1)).alias("genes"), F.sum(F.col("count").cast("double")).alias("total"))
    fields = meta.pivot_fields(store.table("cell_meta"), store.table("cells"), ["CellName", "Mouse", "last"])
    return fields.join(sums, "cell_id", "left").select(F.col("CellName").alias("cell_name"), F.col("Mouse").alias("mouse"), "last", F.coalesce("genes", F.lit(0)).alias("genes"), F.coalesce("total", F.lit(0.0)).alias("total"))


def store_without_meta(spark, d):
    """The genes registered from a file of counts alone: those with any count."""

    def make(store: MatrixStore, root: str) -> None:
        cells, genes = _sides(spark, d)
        counts = counts_of(spark, d).select(F.col("gene_id").alias("row"), F.col("cell_id").alias("column"), "count")
        store.add_cells_without_meta(_write_dense(counts, genes, cells, f"{root}/counts.csv"), ",", [("Kind", "k")])

    store = _cached("plain", spark, d, make)
    return store.table("counts").join(store.table("genes"), "gene_id").groupBy("gene_name").agg(F.count(F.lit(1)).alias("cells"))


def store_expression_of_gene(spark, d):
    store = csv_store(spark, d)
    name = store.gene_name(26)
    return store.get_cells_expression_count(list(range(store.cell_count())), name).select("cell_id", F.col("count").cast("double").alias("count"))


def store_expression_lists(spark, d):
    store = csv_store(spark, d)
    rows = store.get_cells_expression_counts(list(range(store.cell_count())), list(range(0, store.gene_count(), 3)))
    return rows.select("cell_id", F.explode("counts").alias("c")).select("cell_id", "c.gene_id", F.col("c.count").cast("double").alias("count"))


def store_lookups(spark, d):
    """Counts, names and ids one by one, as a client asks for them."""
    store = csv_store(spark, d)
    gene, cell = store.gene_name(26), store.table("cells").filter("cell_id = 7").first()["cell_name"]
    rows = [("genes", store.gene_count()), ("cells", store.cell_count()), ("gene id", store.gene_id_from_name(gene)), ("cell id", store.cell_id_from_string(cell)), ("id as text", store.cell_id_from_string("7")), ("count", int(store.get_cell_expression_count(0, 26))), ("list", store.get_cell_expression_counts(0).count())]
    return spark.createDataFrame(rows, "what string, value bigint")


def store_dense_matrix(spark, d):
    """Every value of the dense matrix by position, but zeros."""
    dense = csv_store(spark, d).get_dense_expression_matrix(normalization="L1")
    return dense.select("cell_id", F.posexplode("expression").alias("place", "value")).filter("value > 0").select("cell_id", "place", F.round("value", 9).alias("value"))


def store_meta_updates(spark, d):
    """A field set for all cells, another added from a file, and both removed from the cells of a set."""
    store = csv_store(spark, d)
    if "updated" not in store.get_cell_set_names():
        cells = cells_of(spark, d)
        store.set_cell_meta_data(cells.select("cell_id", F.lit("Plate").alias("name"), F.coalesce("plate_name", F.lit("")).alias("value")))
        lines = cells.select(F.col("cell_id").cast("bigint").alias("place"), F.concat(_quoted(F.col("cell_name")), F.lit(","), _quoted(F.coalesce("plate_name", F.lit("")))).alias("line"))
        head = spark.createDataFrame([(-1, "cell,Copy")], "place bigint, line string")
        store.add_cell_meta_data(_write_lines(head.unionByName(lines), f"{Scratch(spark, 'copy').root}/copy.csv"))
        store.create_cell_set_using_meta_data("updated", "treated", "true")
        for field in ("Plate", "Copy"):
            store.remove_cell_meta_data("updated", field)
    return store.table("cell_meta").filter("name IN ('Plate', 'Copy')").select("cell_id", "name", "value")


def store_sets(spark, d):
    """Sizes of cell sets and gene sets made in every way."""
    store = csv_store(spark, d)
    if "q_eq" not in store.get_cell_set_names():
        n = store.cell_count()
        store.create_cell_set_using_meta_data("q_eq", "tissue", "stem")
        store.create_cell_set_using_meta_data("q_regex", "tissue", "[a-m].*e", use_regex=True)
        store.create_cell_set_using_numeric_meta_data_between("q_between", "viability", 0.2, 0.7)
        store.create_cell_set_using_numeric_meta_data_greater_than("q_above", "viability", 0.7)
        store.create_cell_set("q_ids", list(range(0, n, 7)))
        store.create_cell_set_union("q_union", ["q_eq", "q_between"])
        store.create_cell_set_intersection("q_both", ["q_regex", "q_between"])
        store.create_cell_set_difference("q_rest", "AllCells", "q_union")
        store.downsample_cell_set("AllCells", "q_sample", 0.25)
        store.create_gene_set_from_regex("q_genes", "P.*")
        store.create_gene_set("q_gene_ids", list(range(0, 1500, 9)))
        store.create_gene_set_difference("q_other_genes", "AllGenes", "q_genes")
        store.create_gene_set_intersection("q_both_genes", ["q_genes", "q_gene_ids"])
        store.create_well_expressed_gene_set("q_well", "q_genes", "q_between", 5)
        store.create_gene_set_using_information_content("q_high", "q_genes", "AllCells", "L1", 4.0)
    return store.cell_set_sizes().unionByName(store.gene_set_sizes()).filter("set_name LIKE 'q%' OR set_name LIKE 'All%'")


def _pairs(spark, d) -> MatrixStore:
    store = csv_store(spark, d)
    if "near" not in store.get_similar_pairs_names():
        store.find_similar_pairs0("near", k=5, threshold=0.5)
    return store


def _graph(spark, d) -> MatrixStore:
    store = _pairs(spark, d)
    if "near" not in store.get_cell_graph_names():
        store.create_cell_graph("near", "near", threshold=0.6, k=3)
    return store


def store_pairs_csv(spark, d):
    path = f"{Scratch(spark, 'pairs').root}/pairs"
    _pairs(spark, d).write_similar_pairs("near", path)
    rows = spark.read.option("header", True).csv(path)
    return rows.select("Cell0", "Cell1", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("Computed", "Exact")])


def store_gene_pairs_csv(spark, d):
    path = f"{Scratch(spark, 'pairs').root}/pairs"
    store = csv_store(spark, d)
    if "near" not in store.get_similar_gene_pairs_names():
        store.find_similar_gene_pairs0("near", k=3, threshold=0.5)
    store.write_similar_gene_pairs("near", path)
    return spark.read.option("header", True).csv(path).select("Gene0", "Gene1", F.round(F.col("Similarity").cast("double"), 6).alias("Similarity"))


def store_dot(spark, d):
    """The lines of a cell graph in Graphviz syntax."""
    path = f"{Scratch(spark, 'dot').root}/dot"
    _graph(spark, d).write_graph("cell_graph", "near", path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def store_cell_report(spark, d):
    rows = csv_store(spark, d).cell_report(0)
    return rows.select("gene_id", "gene_name", F.col("count").cast("double").alias("count"), r6("L1"), r6("L2"))


def store_gene_comparison(spark, d):
    """Two genes side by side, and their similarity."""
    exact, rows = csv_store(spark, d).compare_two_genes(26, 27)
    return rows.select("cell_id", r6("value0"), r6("value1"), F.round(F.lit(exact), 6).alias("similarity"))


def _clusters(spark, d) -> MatrixStore:
    """Clusters by tissue, of whatever size, that stay as they are."""
    store = _graph(spark, d)
    if "tissues" not in store.get_cluster_graph_names():
        own = store.table("cell_meta").filter("name = 'tissue'").select(F.col("cell_id").cast("bigint").alias("id"), "value")
        own = own.join(store.graph("cell_graph", "near")[0], "id", "left_semi")
        labels = own.join(own.groupBy("value").agg(F.min("id").alias("cluster_id")), "value").select("id", "cluster_id")
        store.create_cluster_graph("near", "tissues", labels=Scratch(spark, "labels").keep(labels), min_cluster_size=1, merge_similarity=2.0)
    return store


def store_cluster_cells(spark, d):
    """The clusters as a field of their cells."""
    store = _clusters(spark, d)
    if store.table("cell_meta").filter("name = 'Cluster'").isEmpty():
        store.create_meta_data_from_cluster_graph("tissues", "Cluster")
    rows = store.table("cell_meta").filter("name = 'Cluster'")
    return rows.select("cell_id", F.col("value").cast("bigint").alias("cluster_id"))


def store_cluster_comparison(spark, d):
    """The mean profile of the largest cluster against that of the next two."""
    rows = _clusters(spark, d).compare_clusters("tissues", [0], [1, 2])
    return rows.select("gene_id", r6("a"), r6("b"), r6("most"))


def store_cluster_profile(spark, d):
    return _clusters(spark, d).get_cluster_average_expression("tissues", 1).select("gene_id", r6("average"))


def event_windows(spark, d):
    """Counts per user, kind and hour; the same plan runs on a stream."""
    rows = event_counts(read_table(spark, d, "events"))
    return rows.select(F.col("window.start").alias("start"), "user_id", "event_type", "count")


QUERIES = {
    f.__name__: f
    for f in (
        store_counts, store_names, store_meta, store_json_cells, store_rows_by_cell, store_without_meta, store_expression_of_gene, store_expression_lists,
        store_lookups, store_dense_matrix, store_meta_updates, store_sets, store_pairs_csv, store_gene_pairs_csv, store_dot, store_cell_report,
        store_gene_comparison, store_cluster_cells, store_cluster_comparison, store_cluster_profile, event_windows,
    )
}

# --- SQL ---------------------------------------------------------------------

_NAMES = "cn AS (SELECT cell_id, cell_name FROM (SELECT cell_id, cell_name, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC, cell_name DESC) AS r FROM cells) WHERE r = 1)"
_F = """f AS (SELECT cell_id, name, trim(value, ' \t') AS value FROM (
  SELECT cell_id, lower(trim(meta_name, ' \t')) AS name, meta_value AS value, ROW_NUMBER() OVER (PARTITION BY cell_id, lower(trim(meta_name, ' \t')) ORDER BY loaded_at DESC, ord DESC, meta_value DESC NULLS LAST) AS r FROM cell_meta_data)
  WHERE r = 1 AND value IS NOT NULL AND name <> 'cellname')"""
_NUMBER = "regexp_full_match(value, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"
_VIABLE = f"via AS (SELECT cell_id, CASE WHEN {_NUMBER} THEN CAST(value AS DOUBLE) END AS x FROM f WHERE name = 'viability')"
_NEAR = """sm AS (SELECT cell_id, sum(c) AS s1, sum(c * c) AS s2 FROM e GROUP BY cell_id),
xy AS (SELECT a.cell_id AS id0, b.cell_id AS id1, sum(a.c * b.c) AS xy FROM e a JOIN e b ON a.gene_id = b.gene_id AND a.cell_id <> b.cell_id GROUP BY a.cell_id, b.cell_id),
raw AS (SELECT id0, id1, (1500 * xy - a.s1 * b.s1) / sqrt((1500 * a.s2 - a.s1 * a.s1) * (1500 * b.s2 - b.s1 * b.s1)) AS s FROM xy JOIN sm a ON a.cell_id = id0 JOIN sm b ON b.cell_id = id1),
sim AS (SELECT id0, id1, round(s, 9) AS s, s AS exact FROM raw),
near AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id0 ORDER BY s DESC, id1) AS r FROM sim WHERE s > 0.5) WHERE r <= 5)"""
_GRAPH = f"""{_NEAR}, ed AS (SELECT least(id0, id1) AS src, greatest(id0, id1) AS dst, max(s) AS s FROM near WHERE r <= 3 AND s >= 0.6 GROUP BY 1, 2),
ve AS (SELECT src AS id FROM ed UNION SELECT dst FROM ed)"""
_CLUSTERED = f"""WITH {_E}, {_S}, {_F}, {_GRAPH},
tis AS (SELECT ve.id, f.value FROM ve JOIN f ON f.cell_id = ve.id AND f.name = 'tissue' UNION ALL SELECT id, '' FROM ve WHERE id NOT IN (SELECT cell_id FROM f WHERE name = 'tissue')),
num AS (SELECT value, ROW_NUMBER() OVER (ORDER BY count(*) DESC, min(id)) - 1 AS g, count(*) AS n FROM tis GROUP BY value),
mean AS (SELECT num.g, any_value(num.n) AS n, e.gene_id, sum(e.c / s.n2) / any_value(num.n) AS a FROM tis JOIN num ON num.value = tis.value JOIN e ON e.cell_id = tis.id JOIN s ON s.cell_id = e.cell_id GROUP BY num.g, e.gene_id),
prof AS (SELECT g, n, gene_id, a / sqrt(sum(a * a) OVER (PARTITION BY g)) AS a FROM mean)"""

SQL = {
    "store_counts": f"WITH {_E} SELECT cell_id, gene_id, c AS count FROM e",
    "store_names": f"WITH {_NAMES} SELECT 'cell' AS kind, cell_id AS id, cell_name AS name, cell_name AS value FROM cn UNION ALL SELECT 'gene', gene_id, gene_name, gene_name FROM genes",
    "store_meta": f"""WITH {_NAMES}, {_F}, names AS (SELECT DISTINCT name FROM f)
SELECT cn.cell_id, names.name, coalesce(f.value, '') AS value FROM cn CROSS JOIN names LEFT JOIN f ON f.cell_id = cn.cell_id AND f.name = names.name UNION ALL SELECT cell_id, 'Source', 'csv' FROM cn""",
    "store_json_cells": f"WITH {_E}, {_NAMES} SELECT cell_name, gene_name, c AS count FROM e JOIN cn ON cn.cell_id = e.cell_id JOIN genes ON genes.gene_id = e.gene_id",
    "store_rows_by_cell": f"""WITH {_E}, {_NAMES}, t AS (SELECT cell_id, count(*) AS n, sum(c) AS total FROM e GROUP BY cell_id)
SELECT cell_name, 'm7' AS mouse, 'z' || cn.cell_id AS last, coalesce(n, 0) AS genes, coalesce(total, 0.0) AS total FROM cn LEFT JOIN t ON t.cell_id = cn.cell_id""",
    "store_without_meta": f"WITH {_E} SELECT gene_name, count(*) AS cells FROM e JOIN genes ON genes.gene_id = e.gene_id GROUP BY gene_name",
    "store_expression_of_gene": f"WITH {_E}, {_NAMES} SELECT cn.cell_id, coalesce(c, 0.0) AS count FROM cn LEFT JOIN (SELECT * FROM e WHERE gene_id = 26) x ON x.cell_id = cn.cell_id",
    "store_expression_lists": f"WITH {_E} SELECT cell_id, gene_id, c AS count FROM e WHERE gene_id % 3 = 0",
    "store_lookups": f"""WITH {_E}, {_NAMES} SELECT 'genes' AS what, count(*) AS value FROM genes UNION ALL SELECT 'cells', count(*) FROM cn UNION ALL SELECT 'gene id', 26 UNION ALL SELECT 'cell id', 7 UNION ALL SELECT 'id as text', 7
UNION ALL SELECT 'count', CAST(coalesce(sum(c), 0) AS BIGINT) FROM e WHERE cell_id = 0 AND gene_id = 26 UNION ALL SELECT 'list', count(*) FROM e WHERE cell_id = 0""",
    "store_dense_matrix": f"WITH {_E}, {_S} SELECT e.cell_id, gene_id AS place, round(c / s1, 9) AS value FROM e JOIN s ON s.cell_id = e.cell_id",
    "store_meta_updates": f"""WITH {_C}, {_F}, gone AS (SELECT cell_id FROM f WHERE name = 'treated' AND value = 'true')
SELECT cell_id, name, coalesce(plate_name, '') AS value FROM c CROSS JOIN (SELECT unnest(['Plate', 'Copy']) AS name) WHERE cell_id NOT IN (SELECT cell_id FROM gone)""",
    "store_sets": f"""WITH {_E}, {_NAMES}, {_F}, {_VIABLE}, s1 AS (SELECT cell_id, sum(c) AS s FROM e GROUP BY cell_id),
q_eq AS (SELECT cell_id FROM f WHERE name = 'tissue' AND value = 'stem'), q_regex AS (SELECT cell_id FROM f WHERE name = 'tissue' AND regexp_full_match(value, '[a-m].*e')),
q_between AS (SELECT cell_id FROM via WHERE x BETWEEN 0.2 AND 0.7), q_genes AS (SELECT gene_id FROM genes WHERE gene_name LIKE 'P%'),
q_well AS (SELECT gene_id FROM e WHERE gene_id IN (SELECT gene_id FROM q_genes) AND cell_id IN (SELECT cell_id FROM q_between) GROUP BY gene_id HAVING count(*) >= 5),
v AS (SELECT gene_id, c / s AS x FROM e JOIN s1 ON s1.cell_id = e.cell_id), g AS (SELECT gene_id, sum(x) AS t FROM v GROUP BY gene_id),
h AS (SELECT v.gene_id, sum(x / t * ln(x / t)) AS h FROM v JOIN g ON g.gene_id = v.gene_id GROUP BY v.gene_id),
q_high AS (SELECT q.gene_id FROM q_genes q LEFT JOIN h ON h.gene_id = q.gene_id WHERE ((SELECT ln(count(*)) FROM cn) + coalesce(h, 0)) / ln(2) > 4.0)
SELECT 'AllCells' AS set_name, count(*) AS n FROM cn UNION ALL SELECT 'AllGenes', count(*) FROM genes UNION ALL SELECT 'q_eq', count(*) FROM q_eq UNION ALL SELECT 'q_regex', count(*) FROM q_regex
UNION ALL SELECT 'q_between', count(*) FROM q_between UNION ALL SELECT 'q_above', count(*) FROM via WHERE x >= 0.7 UNION ALL SELECT 'q_ids', count(*) FROM cn WHERE cell_id % 7 = 0
UNION ALL SELECT 'q_union', count(*) FROM (SELECT * FROM q_eq UNION SELECT * FROM q_between) UNION ALL SELECT 'q_both', count(*) FROM (SELECT * FROM q_regex INTERSECT SELECT * FROM q_between)
UNION ALL SELECT 'q_rest', count(*) FROM (SELECT cell_id FROM cn EXCEPT (SELECT * FROM q_eq UNION SELECT * FROM q_between)) UNION ALL SELECT 'q_sample', count(*) FROM cn WHERE md5('231:' || cell_id) < '4000000000000000'
UNION ALL SELECT 'q_genes', count(*) FROM q_genes UNION ALL SELECT 'q_gene_ids', count(*) FROM genes WHERE gene_id % 9 = 0 UNION ALL SELECT 'q_other_genes', count(*) FROM genes WHERE gene_name NOT LIKE 'P%'
UNION ALL SELECT 'q_both_genes', count(*) FROM q_genes WHERE gene_id % 9 = 0 UNION ALL SELECT 'q_well', count(*) FROM q_well UNION ALL SELECT 'q_high', count(*) FROM q_high""",
    "store_pairs_csv": f'WITH {_E}, {_NAMES}, {_NEAR} SELECT a.cell_name AS "Cell0", b.cell_name AS "Cell1", round(s, 6) AS "Computed", round(exact, 6) AS "Exact" FROM near JOIN cn a ON a.cell_id = id0 JOIN cn b ON b.cell_id = id1',
    "store_gene_pairs_csv": f"""WITH {_E}, {_S}, {_NAMES}, w AS (SELECT gene_id AS a, e.cell_id AS f, c / n2 AS x FROM e JOIN s ON s.cell_id = e.cell_id),
gs AS (SELECT a, sum(x) AS s1, sum(x * x) AS s2 FROM w GROUP BY a), n AS (SELECT count(*) AS n FROM cn),
xy AS (SELECT l.a AS id0, r.a AS id1, sum(l.x * r.x) AS xy FROM w l JOIN w r ON l.f = r.f AND l.a <> r.a GROUP BY l.a, r.a),
sim AS (SELECT id0, id1, round((n * xy - a.s1 * b.s1) / sqrt((n * a.s2 - a.s1 * a.s1) * (n * b.s2 - b.s1 * b.s1)), 9) AS s FROM xy CROSS JOIN n JOIN gs a ON a.a = id0 JOIN gs b ON b.a = id1),
near AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id0 ORDER BY s DESC, id1) AS r FROM sim WHERE s > 0.5) WHERE r <= 3),
either AS (SELECT id0, id1, max(s) AS s FROM (SELECT id0, id1, s FROM near UNION ALL SELECT id1, id0, s FROM near) GROUP BY id0, id1)
SELECT a.gene_name AS "Gene0", b.gene_name AS "Gene1", round(s, 6) AS "Similarity" FROM either JOIN genes a ON a.gene_id = id0 JOIN genes b ON b.gene_id = id1""",
    "store_dot": f"""WITH {_E}, {_GRAPH} SELECT 'graph G {{' AS line UNION ALL SELECT '}}' UNION ALL SELECT '  ' || id || ';' FROM ve UNION ALL SELECT '  ' || src || ' -- ' || dst || ' [weight="' || printf('%.6f', round(s, 6)) || '"];' FROM ed""",
    "store_cell_report": f"WITH {_E}, {_S} SELECT e.gene_id, gene_name, c AS count, round(c / s1, 6) AS \"L1\", round(c / n2, 6) AS \"L2\" FROM e JOIN s ON s.cell_id = e.cell_id JOIN genes ON genes.gene_id = e.gene_id WHERE e.cell_id = 0",
    "store_gene_comparison": f"""WITH {_E}, {_S}, {_NAMES}, v AS (SELECT cn.cell_id, coalesce(a.c / s.n2, 0.0) AS x, coalesce(b.c / s.n2, 0.0) AS y FROM cn LEFT JOIN s ON s.cell_id = cn.cell_id
  LEFT JOIN (SELECT * FROM e WHERE gene_id = 26) a ON a.cell_id = cn.cell_id LEFT JOIN (SELECT * FROM e WHERE gene_id = 27) b ON b.cell_id = cn.cell_id)
SELECT cell_id, round(x, 6) AS value0, round(y, 6) AS value1, round((SELECT corr(x, y) FROM v), 6) AS similarity FROM v""",
    "store_cluster_cells": f"{_CLUSTERED} SELECT tis.id AS cell_id, num.g AS cluster_id FROM tis JOIN num ON num.value = tis.value",
    "store_cluster_profile": f"{_CLUSTERED} SELECT gene_id, round(a, 6) AS average FROM prof WHERE g = 1",
    "store_cluster_comparison": f"""{_CLUSTERED}, wa AS (SELECT gene_id, sum(n * a) AS w FROM prof WHERE g = 0 GROUP BY gene_id), wb AS (SELECT gene_id, sum(n * a) AS w FROM prof WHERE g IN (1, 2) GROUP BY gene_id),
na AS (SELECT gene_id, w / (SELECT sqrt(sum(w * w)) FROM wa) AS a FROM wa), nb AS (SELECT gene_id, w / (SELECT sqrt(sum(w * w)) FROM wb) AS b FROM wb)
SELECT coalesce(na.gene_id, nb.gene_id) AS gene_id, round(coalesce(a, 0.0), 6) AS a, round(coalesce(b, 0.0), 6) AS b, round(greatest(coalesce(a, 0.0), coalesce(b, 0.0)), 6) AS most FROM na FULL JOIN nb ON na.gene_id = nb.gene_id""",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, user_id, event_type, count(*) AS count FROM events GROUP BY 1, 2, 3",
}

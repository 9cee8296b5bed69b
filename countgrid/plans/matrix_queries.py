"""The engine's own operators over the driver's matrix tables, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countgrid.operators import graphs, lsh, matrix, meta, sets, similarity
from countgrid.session import Scratch, read_table

BITS = 64
ITERATIONS = 5
LSH_BITS = 1024


def counts_of(spark: SparkSession, d: str) -> DataFrame:
    return matrix.latest_counts(read_table(spark, d, "expression_counts"))


def genes_of(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "genes")


def cells_of(spark: SparkSession, d: str) -> DataFrame:
    """Each cell once: of rows sent again the latest holds."""
    rows = read_table(spark, d, "cells").groupBy("cell_id").agg(F.max(F.struct("loaded_at", "cell_name", "plate_name")).alias("c"))
    return rows.select("cell_id", "c.cell_name", "c.plate_name")


def meta_of(spark: SparkSession, d: str, entity: str = "cell") -> DataFrame:
    """Current meta data as ``cell_id, name, value, ord``: of rows for one field the latest, then the highest ord."""
    key = f"{entity}_id"
    rows = read_table(spark, d, f"{entity}_meta_data").groupBy(key, F.col("meta_name").alias("name")).agg(F.max(F.struct("loaded_at", "ord", "meta_value")).alias("m"))
    return rows.select(key, "name", F.col("m.meta_value").alias("value"), "m.ord").filter("value IS NOT NULL")


def gene_count(spark: SparkSession, d: str) -> int:
    return (genes_of(spark, d).agg(F.max("gene_id")).first()[0] or 0) + 1


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


def cell_norms(spark, d):
    return matrix.cell_sums(counts_of(spark, d)).select("cell_id", "sum1", "sum2", r6("norm2"), F.round("norm1_inverse", 9).alias("norm1_inverse"), F.round("norm2_inverse", 9).alias("norm2_inverse"))


def expression_triples(spark, d):
    return counts_of(spark, d).select("cell_id", "gene_id", F.col("count").cast("double").alias("count"))


def normalized_l1(spark, d):
    return matrix.normalised(counts_of(spark, d), "L1").select("cell_id", "gene_id", F.round("value", 9).alias("value"))


def normalized_l2(spark, d):
    return matrix.normalised(counts_of(spark, d), "L2").select("cell_id", "gene_id", F.round("value", 9).alias("value"))


def aligned_counts(spark, d):
    return matrix.aligned_counts(counts_of(spark, d), cells_of(spark, d), 26)


def counts_for_genes(spark, d):
    chosen = sets.genes_by_regex(genes_of(spark, d), "P.*")
    return matrix.restrict(counts_of(spark, d), chosen).select("cell_id", "gene_id", F.col("count").cast("double").alias("count"))


def compare_two_cells(spark, d):
    return matrix.compare_cells(counts_of(spark, d), 0, 1)


def dense_expression(spark, d):
    dense = matrix.dense_rows(counts_of(spark, d), genes_of(spark, d), cells_of(spark, d))
    ones = F.aggregate("expression", F.lit(0), lambda a, x: a + F.when(x > 0, 1).otherwise(0))
    return dense.select("cell_id", F.size("expression").alias("genes"), ones.alias("expressed"), F.aggregate("expression", F.lit(0.0), lambda a, x: a + x).alias("total"))


def cellset_meta_eq(spark, d):
    return sets.cells_by_value(meta_of(spark, d), "Tissue", "stem")


def cellset_meta_regex(spark, d):
    return sets.cells_by_regex(meta_of(spark, d), "Tissue", "[a-m].*e")


def cellset_meta_numeric(spark, d):
    return sets.cells_by_number(meta_of(spark, d), "Viability", 0.2, 0.7)


def cellset_union(spark, d):
    return sets.union([cellset_meta_eq(spark, d), cellset_meta_numeric(spark, d)])


def cellset_intersection(spark, d):
    return sets.intersection([cellset_meta_regex(spark, d), cellset_meta_numeric(spark, d)])


def cellset_difference(spark, d):
    return sets.difference(cells_of(spark, d).select("cell_id"), cellset_meta_numeric(spark, d))


def cellset_downsample(spark, d):
    return sets.downsample(cells_of(spark, d).select("cell_id"), 0.1, 231)


def geneset_regex(spark, d):
    return sets.genes_by_regex(genes_of(spark, d), "[A-M].*2")


def geneset_difference(spark, d):
    return sets.difference(genes_of(spark, d).select("gene_id"), geneset_regex(spark, d))


def well_expressed_genes(spark, d):
    return sets.well_expressed_genes(counts_of(spark, d), genes_of(spark, d), cellset_meta_numeric(spark, d), 5)


def _information(method):
    def query(spark, d):
        return matrix.information_content(counts_of(spark, d), genes_of(spark, d), cells_of(spark, d), method).select("gene_id", r6("information_content"))

    return query


def high_information_genes(spark, d):
    return sets.high_information_genes(counts_of(spark, d), genes_of(spark, d), cells_of(spark, d), 4.0, "L2")


def meta_histogram(spark, d):
    return meta.histogram(meta_of(spark, d), cells_of(spark, d), "Tissue")


def contingency_table(spark, d):
    return meta.contingency(meta_of(spark, d), cells_of(spark, d), "Tissue", "Treated")


def rand_index(spark, d):
    return meta.rand_index(meta_of(spark, d), cells_of(spark, d), "Tissue", "Treated").select(F.round("rand_index", 9).alias("rand_index"), F.round("adjusted_rand_index", 9).alias("adjusted_rand_index"))


def meta_upsert(spark, d):
    """The plate becomes a field of every cell."""
    updates = cells_of(spark, d).select("cell_id", F.lit("Plate").alias("name"), F.coalesce("plate_name", F.lit("")).alias("value"))
    return meta.upsert(meta_of(spark, d), updates).select("cell_id", "name", "value")


def meta_remove(spark, d):
    return meta.remove_field(meta_of(spark, d), cellset_meta_eq(spark, d), "Tissue").select("cell_id", "name", "value")


def cell_table(spark, d):
    return meta.pivot_fields(meta_of(spark, d), cells_of(spark, d), ["Tissue", "Donor"]).select("cell_id", F.col("Tissue").alias("tissue"), F.col("Donor").alias("donor"))


def _tissues(spark, d):
    return meta.field_of(meta_of(spark, d), cells_of(spark, d), "Tissue").select("cell_id", F.col("value").alias("group_id"))


def average_expression_l2(spark, d):
    return matrix.average_profiles(counts_of(spark, d), _tissues(spark, d), "L2").select("group_id", "gene_id", F.round("average", 8).alias("average"))


def topk_similar_cells(spark, d, k=10):
    return similarity.exact_pairs(counts_of(spark, d), gene_count(spark, d), k, 0.2).select(F.col("id0").cast("int").alias("id0"), F.col("id1").cast("int").alias("id1"), r6("similarity"), F.col("rank").cast("bigint").alias("rank"))


def similar_gene_pairs(spark, d, k=10):
    values = matrix.normalised(counts_of(spark, d), "L2")
    n = cells_of(spark, d).count()
    return similarity.exact_pairs(values, n, k, 0.2, "gene_id", "cell_id", "value").select(F.col("id0").cast("int").alias("id0"), F.col("id1").cast("int").alias("id1"), r6("similarity"), F.col("rank").cast("bigint").alias("rank"))


def _signatures(spark, d, bits=LSH_BITS):
    """Signatures by planes drawn from MD5, which SQL can repeat."""
    return Scratch(spark, "sig").keep(lsh.signatures(counts_of(spark, d), gene_count(spark, d), bits, planes=lsh.md5_planes))


def _pairs(df):
    return df.select("id0", "id1", F.round("similarity", 9).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def sign_signatures(spark, d):
    """The set bits of every signature."""
    text = lsh.text_bits(F.col("sig"), BITS)
    bits = _signatures(spark, d, BITS).select(F.col("id").cast("int").alias("cell_id"), F.posexplode(F.split(text, "")).alias("bit", "on"))
    return bits.filter("on = 'x'").select("cell_id", "bit")


def lsh_signatures(spark, d):
    return _signatures(spark, d).select("id", lsh.text_bits(F.col("sig"), LSH_BITS).alias("signature"))


def lsh_pairs_all(spark, d):
    return _pairs(lsh.lsh_pairs_all(_signatures(spark, d), LSH_BITS, 20, 0.5))


def lsh_pairs_sliced(spark, d):
    return _pairs(lsh.lsh_pairs_sliced(_signatures(spark, d), LSH_BITS, 16, 1000, 20, 0.5))


def lsh_pairs_multi_slice(spark, d):
    return _pairs(lsh.lsh_pairs_multi_slice(_signatures(spark, d), LSH_BITS, [24, 16], 200, 20, 0.5))


def lsh_pairs_permuted(spark, d):
    return _pairs(lsh.lsh_pairs_permuted(_signatures(spark, d), LSH_BITS, 16, 20, 20, 0.5, orders=lsh.md5_orders))


def lsh_common_prefix(spark, d):
    """Bits in which the signatures of cells with consecutive ids agree at first, and bits in which they differ."""
    sigs = _signatures(spark, d)
    after = sigs.select((F.col("id") - 1).alias("id"), F.col("sig").alias("sig1"))
    return sigs.withColumnRenamed("sig", "sig0").join(after, "id").select("id", lsh.common_prefix().alias("prefix"), lsh.mismatches().alias("differing"))


def lsh_error_bins(spark, d):
    """Errors over all pairs of cells."""
    out = lsh.error_bins_of_all(counts_of(spark, d), _signatures(spark, d), gene_count(spark, d), LSH_BITS)
    return out.select("bin", "n", *[r6(c) for c in ("bias", "rms", "center", "expected")])


def stored_pair_errors(spark, d):
    """Errors of a stored pair set against the exact similarity."""
    pairs = latest_pairs(spark, d, "Lsh1024AllGenes")
    exact = similarity.pair_similarity(counts_of(spark, d), pairs, gene_count(spark, d)).withColumn("exact", F.round("exact", 9))
    return lsh.error_bins(exact.filter("exact IS NOT NULL")).select("bin", "n", r6("bias"), r6("rms"), r6("center"))


def lsh_bit_counts(spark, d):
    return lsh.bit_counts(_signatures(spark, d), LSH_BITS)


def signature_counts(spark, d):
    return lsh.signature_counts(_signatures(spark, d, 16)).select(lsh.text_bits(F.col("sig"), 16).alias("signature"), "n", "first_id")


def signature_size_histogram(spark, d):
    return lsh.signature_size_histogram(_signatures(spark, d, 16))


def signature_graph_edges(spark, d):
    return graphs.signature_graph(_signatures(spark, d, 16), 16, 2)[1]


def signature_graph_categories(spark, d):
    """The shares of tissues in each vertex of the signature graph."""
    sigs = _signatures(spark, d, 16)
    groups = _tissues(spark, d).select(F.col("cell_id").cast("bigint").alias("id"), F.col("group_id").alias("value"))
    return graphs.signature_categories(sigs, graphs.signature_graph(sigs, 16, 2)[0], groups).select("id", "value", r6("fraction"))


def latest_pairs(spark, d, name):
    rows = read_table(spark, d, "similar_pairs").filter(F.col("similar_pairs_name") == name)
    rows = rows.groupBy("cell_id0", "cell_id1").agg(F.max(F.struct("computed_at", "similarity")).alias("p"))
    rows = rows.select(F.col("cell_id0").alias("id0"), F.col("cell_id1").alias("id1"), F.col("p.similarity").cast("double").alias("similarity"))
    return rows.filter("similarity IS NOT NULL AND NOT isnan(similarity) AND id0 != id1")


def _members(spark, d):
    return cells_of(spark, d).select(F.col("cell_id").alias("id"))


def knn_graph_edges(spark, d):
    return graphs.knn_graph(latest_pairs(spark, d, "ExactAllGenes"), _members(spark, d), 0.5, 20)[1]


def compare_graphs(spark, d):
    a = graphs.knn_graph(latest_pairs(spark, d, "ExactAllGenes"), _members(spark, d), 0.5, 20)
    b = graphs.knn_graph(latest_pairs(spark, d, "Lsh1024AllGenes"), _members(spark, d), 0.5, 20)
    return graphs.compare_graphs(*a, *b)


def compare_pair_sets(spark, d):
    return lsh.compare_pair_sets(latest_pairs(spark, d, "ExactAllGenes"), latest_pairs(spark, d, "Lsh1024AllGenes"))


def gene_graph_edges(spark, d):
    pairs = similarity.exact_pairs(matrix.normalised(counts_of(spark, d), "L2"), cells_of(spark, d).count(), 20, 0.3, "gene_id", "cell_id", "value")
    return graphs.knn_graph(pairs, genes_of(spark, d).select(F.col("gene_id").alias("id")), 0.5, 20)[1].select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), r6("similarity"))


def _cell_graph(spark, d):
    scratch = Scratch(spark, "graph")
    return tuple(scratch.keep(x) for x in graphs.knn_graph(latest_pairs(spark, d, "ExactAllGenes"), _members(spark, d), 0.5, 20))


def knn_graph_connectivity(spark, d):
    """Number of neighbours of every vertex, the nearest and the farthest of them."""
    near = graphs.connectivity(_cell_graph(spark, d)[1])
    return near.select("id", F.size("neighbours").alias("n"), F.element_at("neighbours", 1)["similarity"].alias("highest"), F.element_at("neighbours", -1)["similarity"].alias("lowest"))


def label_propagation(spark, d):
    """Labels after a fixed number of iterations, as cluster numbers by size."""
    return graphs.label_propagation(*_cell_graph(spark, d), stable_iterations=ITERATIONS + 1, max_iterations=ITERATIONS)


def connected_components(spark, d):
    return graphs.components(*_cell_graph(spark, d))


def graph_similarity_changes(spark, d):
    a = graphs.knn_graph(latest_pairs(spark, d, "ExactAllGenes"), _members(spark, d), 0.5, 20)
    b = graphs.knn_graph(latest_pairs(spark, d, "Lsh1024AllGenes"), _members(spark, d), 0.5, 20)
    return graphs.similarity_changes(a[1], b[1]).select(F.round("change", 2).alias("change"), "n")


def _tissue_clusters(spark, d):
    """The cluster graph over the vertices of the cell graph with the tissues as clusters, named by their smallest cell."""
    scratch = Scratch(spark, "tissues")
    vertices, edges = _cell_graph(spark, d)
    own = _tissues(spark, d).select(F.col("cell_id").alias("id"), "group_id").join(vertices, "id", "left_semi")
    names = own.groupBy("group_id").agg(F.min("id").cast("bigint").alias("cluster_id"))
    labels = scratch.keep(own.join(names, "group_id").select("id", "cluster_id"))
    return graphs.cluster_graph(vertices, edges, counts_of(spark, d), gene_count(spark, d), labels=labels, min_cluster_size=20, merge_similarity=0.94, threshold=0.8, k=2)


def cluster_graph(spark, d):
    """The clusters' cells; those of dissolved clusters have none."""
    made = _tissue_clusters(spark, d)
    return made["members"].unionByName(made["unclustered"].withColumn("cluster_id", F.lit(None).cast("bigint")))


def cluster_graph_edges(spark, d):
    return _tissue_clusters(spark, d)["edges"].select("c0", "c1", r6("similarity"))


def cluster_graph_profiles(spark, d):
    return _tissue_clusters(spark, d)["profiles"].select("cluster_id", "gene_id", r6("average"))


def vertex_tissue_frequencies(spark, d):
    groups = _tissues(spark, d).select(F.col("cell_id").alias("id"), F.col("group_id").alias("value"))
    return graphs.group_frequencies(_cell_graph(spark, d)[0], groups)


def vertex_category_colors(spark, d):
    groups = _tissues(spark, d).select(F.col("cell_id").alias("id"), F.col("group_id").alias("value"))
    return graphs.category_colors(_cell_graph(spark, d)[0], groups)


def vertex_expression_colors(spark, d):
    """The vertices coloured by the normalised count of one gene."""
    values = matrix.normalised(counts_of(spark, d), "L2").filter("gene_id = 26").select(F.col("cell_id").alias("id"), F.round("value", 6).alias("value"))
    return graphs.scale_colors(_cell_graph(spark, d)[0], values).select("id", "value", "color")


def vertex_similarity_colors(spark, d):
    """The vertices coloured by their similarity to one cell."""
    pairs = _cell_graph(spark, d)[0].select(F.lit(0).alias("id0"), F.col("id").alias("id1"))
    values = similarity.pair_similarity(counts_of(spark, d), pairs, gene_count(spark, d)).select(F.col("id1").alias("id"), F.round("exact", 6).alias("value"))
    return graphs.scale_colors(_cell_graph(spark, d)[0], values, 0.0, 1.0).select("id", "value", "color")


def cluster_profile_similarity(spark, d):
    profiles = Scratch(spark, "profiles").keep(matrix.average_profiles(counts_of(spark, d), _tissues(spark, d), "L2"))
    # Profiles are non-negative: groups without a common gene have no similarity above 0, and no row here or in SQL.
    side = lambda k: profiles.select(F.col("group_id").alias(f"id{k}"), "gene_id")
    pairs = side(0).join(side(1), "gene_id").filter("id0 < id1").select("id0", "id1").distinct()
    return similarity.pair_similarity(profiles, pairs, gene_count(spark, d), "group_id", "gene_id", "average").select("id0", "id1", r6("exact"))


def gene_report(spark, d):
    """The cells of one gene by normalised count, with a field beside."""
    values = matrix.normalised(counts_of(spark, d), "L2").filter("gene_id = 26").select("cell_id", r6("value"))
    return values.join(_tissues(spark, d), "cell_id").select("cell_id", "value", F.col("group_id").alias("tissue")).orderBy(F.desc("value"), "cell_id")


QUERIES = {
    f.__name__: f
    for f in (
        cell_norms, expression_triples, normalized_l1, normalized_l2, aligned_counts, counts_for_genes, compare_two_cells, dense_expression,
        cellset_meta_eq, cellset_meta_regex, cellset_meta_numeric, cellset_union, cellset_intersection, cellset_difference, cellset_downsample,
        geneset_regex, geneset_difference, well_expressed_genes, high_information_genes, meta_histogram, contingency_table, rand_index, meta_upsert,
        meta_remove, cell_table, average_expression_l2, topk_similar_cells, similar_gene_pairs, sign_signatures, lsh_signatures, lsh_pairs_all,
        lsh_pairs_sliced, lsh_pairs_multi_slice, lsh_pairs_permuted, lsh_common_prefix, lsh_error_bins, stored_pair_errors, lsh_bit_counts,
        signature_counts, signature_size_histogram, signature_graph_edges, signature_graph_categories,
        knn_graph_edges, knn_graph_connectivity, compare_graphs, graph_similarity_changes, compare_pair_sets, gene_graph_edges, label_propagation,
        connected_components, cluster_graph, cluster_graph_edges, cluster_graph_profiles, cluster_profile_similarity, gene_report,
        vertex_tissue_frequencies, vertex_category_colors, vertex_expression_colors, vertex_similarity_colors,
    )
} | {f"gene_information_content_{m.lower()}": _information(m) for m in ("none", "L1", "L2")}

# --- SQL ---------------------------------------------------------------------

_E = """e AS (SELECT cell_id, gene_id, CAST(expr_count AS DOUBLE) AS c FROM (
  SELECT cell_id, gene_id, expr_count, ROW_NUMBER() OVER (PARTITION BY cell_id, gene_id ORDER BY loaded_at DESC, expr_count DESC NULLS LAST) AS r FROM expression_counts)
  WHERE r = 1 AND expr_count > 0 AND NOT isnan(expr_count))"""
_C = """c AS (SELECT cell_id, plate_name FROM (SELECT cell_id, plate_name, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC, cell_name DESC, plate_name DESC NULLS LAST) AS r FROM cells) WHERE r = 1)"""
_M = """m AS (SELECT cell_id, meta_name AS name, meta_value AS value FROM (
  SELECT cell_id, meta_name, meta_value, ROW_NUMBER() OVER (PARTITION BY cell_id, meta_name ORDER BY loaded_at DESC, ord DESC, meta_value DESC NULLS LAST) AS r FROM cell_meta_data)
  WHERE r = 1 AND value IS NOT NULL)"""
_S = "s AS (SELECT cell_id, sum(c) AS s1, sum(c * c) AS s2, sqrt(sum(c * c)) AS n2 FROM e GROUP BY cell_id)"
_NUMBER = "regexp_full_match(value, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"
_VIABLE = f"viable AS (SELECT DISTINCT cell_id FROM (SELECT cell_id, CASE WHEN {_NUMBER} THEN CAST(value AS DOUBLE) END AS x FROM m WHERE name = 'Viability') WHERE x BETWEEN 0.2 AND 0.7)"
_TISSUE = "t AS (SELECT c.cell_id, coalesce(m.value, '') AS v FROM c LEFT JOIN (SELECT * FROM m WHERE name = 'Tissue') m ON c.cell_id = m.cell_id)"
_TREATED = "u AS (SELECT c.cell_id, coalesce(m.value, '') AS v FROM c LEFT JOIN (SELECT * FROM m WHERE name = 'Treated') m ON c.cell_id = m.cell_id)"


def _information_sql(weight: str) -> str:
    return f"""WITH {_E}, {_C}, {_S},
v AS (SELECT e.gene_id, e.c * {weight} AS x FROM e JOIN s ON e.cell_id = s.cell_id WHERE e.cell_id IN (SELECT cell_id FROM c)),
g AS (SELECT gene_id, sum(x) AS t FROM v GROUP BY gene_id),
i AS (SELECT v.gene_id, sum(x / t * ln(x / t)) AS h FROM v JOIN g ON v.gene_id = g.gene_id GROUP BY v.gene_id)
SELECT genes.gene_id, round(((SELECT ln(count(*)) FROM c) + coalesce(i.h, 0)) / ln(2), 6) AS information_content FROM genes LEFT JOIN i ON genes.gene_id = i.gene_id"""


def _pairs_sql(name: str) -> str:
    return f"""(SELECT cell_id0 AS id0, cell_id1 AS id1, CAST(similarity AS DOUBLE) AS similarity FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id0, cell_id1 ORDER BY computed_at DESC) AS r FROM similar_pairs WHERE similar_pairs_name = '{name}')
  WHERE r = 1 AND similarity IS NOT NULL AND NOT isnan(similarity) AND cell_id0 <> cell_id1)"""


def _edges_sql(name: str) -> str:
    return f"""(SELECT least(id0, id1) AS src, greatest(id0, id1) AS dst, max(similarity) AS similarity FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY id0 ORDER BY similarity DESC, id1) AS k FROM {_pairs_sql(name)} p
  WHERE similarity >= 0.5 AND id0 IN (SELECT cell_id FROM c) AND id1 IN (SELECT cell_id FROM c)) WHERE k <= 20 GROUP BY 1, 2)"""


def _topk_sql(rows: str, n: str, k: int, threshold: float) -> str:
    """All pairs that share a feature; others have no similarity above 0."""
    return f"""s AS (SELECT a, sum(x) AS s1, sum(x * x) AS s2 FROM {rows} GROUP BY a),
p AS (SELECT l.a, r.a AS b, sum(l.x * r.x) AS xy FROM {rows} l JOIN {rows} r ON l.f = r.f AND l.a <> r.a GROUP BY l.a, r.a),
q AS (SELECT p.a AS id0, p.b AS id1, round(({n} * xy - sa.s1 * sb.s1) / sqrt(({n} * sa.s2 - sa.s1 * sa.s1) * ({n} * sb.s2 - sb.s1 * sb.s1)), 9) AS similarity
  FROM p JOIN s sa ON sa.a = p.a JOIN s sb ON sb.a = p.b),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id0 ORDER BY similarity DESC, id1) AS rank FROM q WHERE similarity > {threshold}),
top AS (SELECT * FROM best WHERE rank <= {k})"""


_PROFILES = """v AS (SELECT e.cell_id, e.gene_id, e.c / s.n2 AS x FROM e JOIN s ON e.cell_id = s.cell_id),
sizes AS (SELECT v, count(*) AS n FROM t GROUP BY v),
means AS (SELECT t.v AS g, v.gene_id, sum(x) / any_value(n) AS a FROM v JOIN t ON v.cell_id = t.cell_id JOIN sizes ON sizes.v = t.v GROUP BY t.v, v.gene_id),
norms AS (SELECT g, sqrt(sum(a * a)) AS norm FROM means GROUP BY g),
prof AS (SELECT means.g, gene_id, a / norm AS a FROM means JOIN norms ON means.g = norms.g)"""



def _sig_sql(bits: int) -> str:
    """Signatures by MD5 planes: the hex digits of MD5 of seed:gene:block, four bits each."""
    return f"""bits AS (SELECT unnest(generate_series(0, {bits - 1})) AS bit),
planes AS (SELECT gene_id, bit, 2 * (((strpos('0123456789abcdef', substr(md5('231:' || gene_id || ':' || (bit // 128)), CAST(1 + (bit % 128) // 4 AS INTEGER), 1)) - 1) >> CAST(3 - bit % 4 AS INTEGER)) & 1) - 1 AS sign FROM genes CROSS JOIN bits),
plane_sums AS (SELECT bit, sum(sign) AS total FROM planes GROUP BY bit), row_sums AS (SELECT cell_id, sum(c) AS s FROM e GROUP BY cell_id),
side AS (SELECT cell_id, bit, sum(c * sign) AS p FROM e JOIN planes ON e.gene_id = planes.gene_id GROUP BY cell_id, bit),
flags AS (SELECT side.cell_id, side.bit, CASE WHEN p * 1500 > s * total THEN '1' ELSE '0' END AS flag FROM side JOIN row_sums ON side.cell_id = row_sums.cell_id JOIN plane_sums ON side.bit = plane_sums.bit),
sig AS (SELECT CAST(cell_id AS BIGINT) AS id, string_agg(flag, '' ORDER BY bit) AS t FROM flags GROUP BY cell_id)"""


def _slices_sql(length: int) -> str:
    return f"s{length} AS (SELECT id, k, substr(t, CAST(1 + {length} * k AS INTEGER), {length}) AS v FROM sig CROSS JOIN (SELECT unnest(generate_series(0, {LSH_BITS // length - 1})) AS k))"


#: The 20 best candidates of every row by signature.
_BEST_SIG = f"""scored AS (SELECT cand.id0, cand.id1, bit_count(xor(CAST(a.t AS BIT), CAST(b.t AS BIT))) AS m FROM cand JOIN sig a ON a.id = cand.id0 JOIN sig b ON b.id = cand.id1),
est AS (SELECT id0, id1, m, cos(m * pi() / {LSH_BITS}) AS similarity FROM scored)
SELECT id0, id1, round(similarity, 9) AS similarity, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id0 ORDER BY m, id1) AS rank FROM est WHERE similarity > 0.5) WHERE rank <= 20"""

#: The similarity of all unordered pairs of cells with counts.
_EXACT_ALL = """s AS (SELECT cell_id, sum(c) AS s1, sum(c * c) AS s2 FROM e GROUP BY cell_id),
xy AS (SELECT a.cell_id AS id0, b.cell_id AS id1, sum(a.c * b.c) AS xy FROM e a JOIN e b ON a.gene_id = b.gene_id AND a.cell_id < b.cell_id GROUP BY a.cell_id, b.cell_id),
x AS (SELECT a.cell_id AS id0, b.cell_id AS id1, round((1500 * coalesce(xy, 0) - a.s1 * b.s1) / sqrt((1500 * a.s2 - a.s1 * a.s1) * (1500 * b.s2 - b.s1 * b.s1)), 9) AS exact
  FROM s a JOIN s b ON a.cell_id < b.cell_id LEFT JOIN xy ON xy.id0 = a.cell_id AND xy.id1 = b.cell_id)"""


def _labels_sql(iterations: int) -> str:
    """Label propagation, one group of subqueries an iteration."""
    steps = ""
    for i in range(iterations):
        steps += f""",
w{i} AS (SELECT b.id, l.label, round(sum(b.similarity), 9) AS w FROM b JOIN l{i} l ON l.id = b.other GROUP BY b.id, l.label),
r{i} AS (SELECT w.id, w.label, ROW_NUMBER() OVER (PARTITION BY w.id ORDER BY w.w DESC, w.label = l.label DESC, w.label) AS r FROM w{i} w JOIN l{i} l ON l.id = w.id),
l{i + 1} AS (SELECT l.id, CASE WHEN substr(md5(l.id || ':231:{i}'), 1, 1) < '8' THEN coalesce(r.label, l.label) ELSE l.label END AS label FROM l{i} l LEFT JOIN r{i} r ON r.id = l.id AND r.r = 1)"""
    return f"""WITH {_C}, x AS {_edges_sql('ExactAllGenes')}, b AS MATERIALIZED (SELECT src AS id, dst AS other, similarity FROM x UNION ALL SELECT dst, src, similarity FROM x),
l0 AS (SELECT DISTINCT id, id AS label FROM b){steps.replace("AS (SELECT l.id", "AS MATERIALIZED (SELECT l.id")},
sizes AS (SELECT label, ROW_NUMBER() OVER (ORDER BY count(*) DESC, min(id)) - 1 AS number FROM l{iterations} GROUP BY label)
SELECT id, number AS cluster_id FROM l{iterations} l JOIN sizes ON sizes.label = l.label"""


_PROFILE_SIMILARITY = "(1500 * coalesce(xy, 0) - x0.s1 * y0.s1) / sqrt((1500 * x0.s2 - x0.s1 * x0.s1) * (1500 * y0.s2 - y0.s1 * y0.s1))"


def _profiles_sql(groups: str, n: str) -> str:
    """L2 profiles of the groups of a table (id, g), and their sums."""
    return f"""means{n} AS (SELECT k.g, u.gene_id, sum(u.x) / any_value(z.n) AS a FROM unit u JOIN {groups} k ON k.id = u.cell_id JOIN (SELECT g, count(*) AS n FROM {groups} GROUP BY g) z ON z.g = k.g GROUP BY k.g, u.gene_id),
prof{n} AS (SELECT m.g, gene_id, a / norm AS a FROM means{n} m JOIN (SELECT g, sqrt(sum(a * a)) AS norm FROM means{n} GROUP BY g) q ON q.g = m.g),
ps{n} AS (SELECT g, sum(a) AS s1, sum(a * a) AS s2 FROM prof{n} GROUP BY g)"""


#: The cluster graph of the tissues: merged at 0.94, from 20 cells, numbered by size.
_CLUSTERS = f"""WITH RECURSIVE {_E}, {_S}, {_M}, {_C}, {_TISSUE}, x AS MATERIALIZED {_edges_sql('ExactAllGenes')},
unit AS (SELECT e.cell_id, e.gene_id, e.c / s.n2 AS x FROM e JOIN s ON e.cell_id = s.cell_id),
vert AS (SELECT src AS id FROM x UNION SELECT dst FROM x),
own AS (SELECT vert.id, min(vert.id) OVER (PARTITION BY t.v) AS g FROM vert JOIN t ON t.cell_id = vert.id),
{_profiles_sql('own', '1')},
links AS (SELECT DISTINCT least(a.g, b.g) AS c0, greatest(a.g, b.g) AS c1 FROM x JOIN own a ON a.id = x.src JOIN own b ON b.id = x.dst WHERE a.g <> b.g),
close AS (SELECT l.c0, l.c1 FROM links l JOIN ps1 x0 ON x0.g = l.c0 JOIN ps1 y0 ON y0.g = l.c1
  LEFT JOIN (SELECT a.g AS g0, b.g AS g1, sum(a.a * b.a) AS xy FROM prof1 a JOIN prof1 b ON a.gene_id = b.gene_id GROUP BY a.g, b.g) xy ON xy.g0 = l.c0 AND xy.g1 = l.c1
  WHERE {_PROFILE_SIMILARITY} > 0.94),
ways0 AS (SELECT c0 AS a, c1 AS b FROM close UNION SELECT c1, c0 FROM close),
merge AS (SELECT DISTINCT g AS a, g AS b FROM own UNION SELECT merge.a, ways0.b FROM merge JOIN ways0 ON merge.b = ways0.a),
final AS (SELECT own.id, m.cl FROM own JOIN (SELECT a, min(b) AS cl FROM merge GROUP BY a) m ON m.a = own.g),
nums AS (SELECT cl, ROW_NUMBER() OVER (ORDER BY count(*) DESC, min(id)) - 1 AS num FROM final GROUP BY cl HAVING count(*) >= 20),
numbered AS (SELECT final.id, nums.num AS g FROM final JOIN nums ON nums.cl = final.cl),
{_profiles_sql('numbered', '2')}"""


def _scale_sql(low: str, high: str) -> str:
    """Colours from red over yellow to green between two values; black without a value."""
    return f"""frac AS (SELECT vert.id, val.value, CASE WHEN {high} > {low} THEN (val.value - {low}) / ({high} - {low}) ELSE 0.0 END AS f FROM vert LEFT JOIN val ON val.id = vert.id)
SELECT id, value, CASE WHEN value IS NULL THEN '#000000' ELSE printf('#%02x%02x00', CAST(round(greatest(least(1.0, 2 - 2 * f), 0.0) * 255) AS INTEGER), CAST(round(greatest(least(1.0, 2 * f), 0.0) * 255) AS INTEGER)) END AS color FROM frac"""


SQL = {
    "cell_norms": f"WITH {_E}, {_S} SELECT cell_id, s1 AS sum1, s2 AS sum2, round(n2, 6) AS norm2, round(1 / s1, 9) AS norm1_inverse, round(1 / n2, 9) AS norm2_inverse FROM s",
    "expression_triples": f"WITH {_E} SELECT cell_id, gene_id, c AS count FROM e",
    "normalized_l1": f"WITH {_E}, {_S} SELECT e.cell_id, gene_id, round(c / s1, 9) AS value FROM e JOIN s ON e.cell_id = s.cell_id",
    "normalized_l2": f"WITH {_E}, {_S} SELECT e.cell_id, gene_id, round(c / n2, 9) AS value FROM e JOIN s ON e.cell_id = s.cell_id",
    "aligned_counts": f"WITH {_E}, {_C} SELECT c.cell_id, coalesce(x.c, 0) AS count FROM c LEFT JOIN (SELECT * FROM e WHERE gene_id = 26) x ON c.cell_id = x.cell_id",
    "counts_for_genes": f"WITH {_E} SELECT cell_id, gene_id, c AS count FROM e WHERE gene_id IN (SELECT gene_id FROM genes WHERE gene_name LIKE 'P%')",
    "compare_two_cells": f"""WITH {_E} SELECT coalesce(a.gene_id, b.gene_id) AS gene_id, coalesce(a.c, 0) AS count0, coalesce(b.c, 0) AS count1, coalesce(a.c, 0) + coalesce(b.c, 0) AS total
FROM (SELECT * FROM e WHERE cell_id = 0) a FULL JOIN (SELECT * FROM e WHERE cell_id = 1) b ON a.gene_id = b.gene_id""",
    "dense_expression": f"""WITH {_E}, {_C} SELECT c.cell_id, CAST((SELECT count(*) FROM genes) AS INTEGER) AS genes, CAST(coalesce(x.n, 0) AS INTEGER) AS expressed, coalesce(x.total, 0) AS total
FROM c LEFT JOIN (SELECT cell_id, count(*) AS n, sum(c) AS total FROM e GROUP BY cell_id) x ON c.cell_id = x.cell_id""",
    "cellset_meta_eq": f"WITH {_M} SELECT DISTINCT cell_id FROM m WHERE name = 'Tissue' AND value = 'stem'",
    "cellset_meta_regex": f"WITH {_M} SELECT DISTINCT cell_id FROM m WHERE name = 'Tissue' AND regexp_full_match(value, '[a-m].*e')",
    "cellset_meta_numeric": f"WITH {_M}, {_VIABLE} SELECT cell_id FROM viable",
    "cellset_union": f"WITH {_M}, {_VIABLE} SELECT cell_id FROM viable UNION SELECT cell_id FROM m WHERE name = 'Tissue' AND value = 'stem'",
    "cellset_intersection": f"WITH {_M}, {_VIABLE} SELECT cell_id FROM viable INTERSECT SELECT cell_id FROM m WHERE name = 'Tissue' AND regexp_full_match(value, '[a-m].*e')",
    "cellset_difference": f"WITH {_M}, {_VIABLE}, {_C} SELECT cell_id FROM c EXCEPT SELECT cell_id FROM viable",
    "cellset_downsample": f"WITH {_C} SELECT cell_id FROM c WHERE md5('231:' || cell_id) < '1999999999999a00'",
    "geneset_regex": "SELECT gene_id FROM genes WHERE regexp_full_match(gene_name, '[A-M].*2')",
    "geneset_difference": "SELECT gene_id FROM genes EXCEPT SELECT gene_id FROM genes WHERE regexp_full_match(gene_name, '[A-M].*2')",
    "well_expressed_genes": f"WITH {_E}, {_M}, {_VIABLE} SELECT gene_id FROM e WHERE cell_id IN (SELECT cell_id FROM viable) AND gene_id IN (SELECT gene_id FROM genes) GROUP BY gene_id HAVING count(*) >= 5",
    "gene_information_content_none": _information_sql("1"),
    "gene_information_content_l1": _information_sql("(1 / s.s1)"),
    "gene_information_content_l2": _information_sql("(1 / s.n2)"),
    "high_information_genes": f"SELECT gene_id FROM ({_information_sql('(1 / s.n2)')}) WHERE information_content > 4.0",
    "meta_histogram": f"WITH {_M}, {_C}, {_TISSUE} SELECT v AS value, count(*) AS n FROM t GROUP BY v",
    "contingency_table": f"WITH {_M}, {_C}, {_TISSUE}, {_TREATED} SELECT t.v AS value0, u.v AS value1, count(*) AS n FROM t JOIN u ON t.cell_id = u.cell_id GROUP BY CUBE (t.v, u.v)",
    "rand_index": f"""WITH {_M}, {_C}, {_TISSUE}, {_TREATED},
ij AS (SELECT t.v AS x, u.v AS y, count(*) AS n FROM t JOIN u ON t.cell_id = u.cell_id GROUP BY t.v, u.v),
sums AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ij) AS a,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM ij GROUP BY x)) AS r, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM ij GROUP BY y)) AS k,
  (SELECT sum(n) * (sum(n) - 1) / 2 FROM ij) AS tot),
four AS (SELECT CAST(a AS DOUBLE) AS a, CAST(r - a AS DOUBLE) AS b, CAST(k - a AS DOUBLE) AS c, CAST(tot - r - k + a AS DOUBLE) AS d, CAST(tot AS DOUBLE) AS n FROM sums)
SELECT round((a + d) / n, 9) AS rand_index, round((n * (a + d) - ((a + b) * (a + c) + (c + d) * (b + d))) / (n * n - ((a + b) * (a + c) + (c + d) * (b + d))), 9) AS adjusted_rand_index FROM four""",
    "meta_upsert": f"WITH {_M}, {_C} SELECT cell_id, name, value FROM m WHERE name <> 'Plate' OR cell_id NOT IN (SELECT cell_id FROM c) UNION ALL SELECT cell_id, 'Plate' AS name, coalesce(plate_name, '') AS value FROM c",
    "meta_remove": f"WITH {_M} SELECT cell_id, name, value FROM m WHERE NOT (name = 'Tissue' AND cell_id IN (SELECT cell_id FROM m WHERE name = 'Tissue' AND value = 'stem'))",
    "cell_table": f"WITH {_M}, {_C}, {_TISSUE} SELECT t.cell_id, t.v AS tissue, coalesce(d.value, '') AS donor FROM t LEFT JOIN (SELECT * FROM m WHERE name = 'Donor') d ON t.cell_id = d.cell_id",
    "average_expression_l2": f"WITH {_E}, {_S}, {_M}, {_C}, {_TISSUE}, {_PROFILES} SELECT g AS group_id, gene_id, round(a, 8) AS average FROM prof",
    "cluster_profile_similarity": f"""WITH {_E}, {_S}, {_M}, {_C}, {_TISSUE}, {_PROFILES},
ps AS (SELECT g, sum(a) AS s1, sum(a * a) AS s2 FROM prof GROUP BY g),
names AS (SELECT DISTINCT g FROM prof),
xy AS (SELECT l.g AS id0, r.g AS id1, sum(l.a * r.a) AS xy FROM prof l JOIN prof r ON l.gene_id = r.gene_id AND l.g < r.g GROUP BY l.g, r.g)
SELECT id0, id1, round((1500 * xy - x.s1 * y.s1) / sqrt((1500 * x.s2 - x.s1 * x.s1) * (1500 * y.s2 - y.s1 * y.s1)), 6) AS exact FROM xy JOIN ps x ON x.g = id0 JOIN ps y ON y.g = id1""",
    "topk_similar_cells": f"WITH {_E}, w AS (SELECT cell_id AS a, gene_id AS f, c AS x FROM e), {_topk_sql('w', '1500', 10, 0.2)} SELECT id0, id1, round(similarity, 6) AS similarity, rank FROM top",
    "similar_gene_pairs": f"WITH {_E}, {_C}, n AS (SELECT cell_id, sqrt(sum(c * c)) AS n2 FROM e GROUP BY cell_id), w AS (SELECT gene_id AS a, e.cell_id AS f, c / n2 AS x FROM e JOIN n ON e.cell_id = n.cell_id), {_topk_sql('w', '(SELECT count(*) FROM c)', 10, 0.2)} SELECT id0, id1, round(similarity, 6) AS similarity, rank FROM top",
    "gene_graph_edges": f"""WITH {_E}, {_C}, n AS (SELECT cell_id, sqrt(sum(c * c)) AS n2 FROM e GROUP BY cell_id), w AS (SELECT gene_id AS a, e.cell_id AS f, c / n2 AS x FROM e JOIN n ON e.cell_id = n.cell_id), {_topk_sql('w', '(SELECT count(*) FROM c)', 20, 0.3)}
SELECT least(id0, id1) AS src, greatest(id0, id1) AS dst, round(max(similarity), 6) AS similarity FROM top WHERE similarity >= 0.5 GROUP BY 1, 2""",
    "sign_signatures": f"""WITH {_E}, {_sig_sql(BITS)}
SELECT cell_id, CAST(bit AS INTEGER) AS bit FROM flags WHERE flag = '1'""",
    "lsh_signatures": f"WITH {_E}, {_sig_sql(LSH_BITS)} SELECT id, translate(t, '01', '_x') AS signature FROM sig",
    "lsh_pairs_all": f"WITH {_E}, {_sig_sql(LSH_BITS)}, cand AS (SELECT a.id AS id0, b.id AS id1 FROM sig a JOIN sig b ON a.id <> b.id), {_BEST_SIG}",
    "lsh_pairs_sliced": f"""WITH {_E}, {_sig_sql(LSH_BITS)}, {_slices_sql(16)},
cand AS (SELECT DISTINCT a.id AS id0, b.id AS id1 FROM s16 a JOIN s16 b ON a.k = b.k AND a.v = b.v AND a.id <> b.id), {_BEST_SIG}""",
    "lsh_pairs_multi_slice": f"""WITH {_E}, {_sig_sql(LSH_BITS)}, {_slices_sql(24)}, {_slices_sql(16)},
shared AS (SELECT 0 AS place, a.k, a.id AS id0, b.id AS id1 FROM s24 a JOIN s24 b ON a.k = b.k AND a.v = b.v AND a.id <> b.id
  UNION ALL SELECT 1, a.k, a.id, b.id FROM s16 a JOIN s16 b ON a.k = b.k AND a.v = b.v AND a.id <> b.id),
firsts AS (SELECT id0, id1, min(place * 1000 + k) AS spot FROM shared GROUP BY id0, id1),
cand AS (SELECT id0, id1 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id0 ORDER BY spot, id1) AS r FROM firsts) WHERE r <= 200), {_BEST_SIG.replace("similarity > 0.5", "m < 341")}""",
    "lsh_pairs_permuted": f"""WITH {_E}, {_sig_sql(LSH_BITS)},
orders AS (SELECT p, bit, ROW_NUMBER() OVER (PARTITION BY p ORDER BY md5('231:' || p || ':' || bit)) AS r FROM (SELECT unnest(generate_series(0, 15)) AS p) CROSS JOIN bits),
keys AS (SELECT p, id, string_agg(substr(t, CAST(bit + 1 AS INTEGER), 1), '' ORDER BY r) AS key FROM sig CROSS JOIN orders WHERE r <= 63 GROUP BY p, id),
placed AS (SELECT p, id, ROW_NUMBER() OVER (PARTITION BY p ORDER BY key, id) AS r FROM keys),
cand AS (SELECT DISTINCT a.id AS id0, b.id AS id1 FROM placed a JOIN placed b ON a.p = b.p AND b.r BETWEEN a.r - 20 AND a.r + 20 AND a.id <> b.id), {_BEST_SIG}""",
    "lsh_common_prefix": f"""WITH {_E}, {_sig_sql(LSH_BITS)},
x AS (SELECT a.id, CAST(xor(CAST(a.t AS BIT), CAST(b.t AS BIT)) AS VARCHAR) AS d FROM sig a JOIN sig b ON b.id = a.id + 1)
SELECT id, CAST(CASE WHEN contains(d, '1') THEN strpos(d, '1') - 1 ELSE {LSH_BITS} END AS INTEGER) AS prefix, CAST(length(replace(d, '0', '')) AS INTEGER) AS differing FROM x""",
    "lsh_error_bins": f"""WITH {_E}, {_sig_sql(LSH_BITS)}, {_EXACT_ALL},
j AS (SELECT x.exact, cos(bit_count(xor(CAST(a.t AS BIT), CAST(b.t AS BIT))) * pi() / {LSH_BITS}) AS est FROM x JOIN sig a ON a.id = x.id0 JOIN sig b ON b.id = x.id1),
d AS (SELECT CAST(least(floor((exact + 1) / 0.01), 199) AS INTEGER) AS bin, est - exact AS d FROM j),
g AS (SELECT bin, count(*) AS n, avg(d) AS bias, sqrt(avg(d * d)) AS rms, CAST(bin AS DOUBLE) * 0.01 - 0.995 AS center FROM d GROUP BY bin HAVING count(*) >= 2)
SELECT bin, n, round(bias, 6) AS bias, round(rms, 6) AS rms, round(center, 6) AS center,
  round(pi() * sin(acos(center)) * sqrt((1 - acos(center) / pi()) * (acos(center) / pi()) / {LSH_BITS}), 6) AS expected FROM g""",
    "stored_pair_errors": f"""WITH {_E}, st AS {_pairs_sql('Lsh1024AllGenes')},
s AS (SELECT cell_id, sum(c) AS s1, sum(c * c) AS s2 FROM e GROUP BY cell_id),
xy AS (SELECT st.id0, st.id1, sum(a.c * b.c) AS xy FROM st JOIN e a ON a.cell_id = st.id0 JOIN e b ON b.cell_id = st.id1 AND a.gene_id = b.gene_id GROUP BY st.id0, st.id1),
j AS (SELECT st.similarity, round((1500 * coalesce(xy, 0) - a.s1 * b.s1) / sqrt((1500 * a.s2 - a.s1 * a.s1) * (1500 * b.s2 - b.s1 * b.s1)), 9) AS exact
  FROM st JOIN s a ON a.cell_id = st.id0 JOIN s b ON b.cell_id = st.id1 LEFT JOIN xy ON xy.id0 = st.id0 AND xy.id1 = st.id1),
d AS (SELECT CAST(least(floor((exact + 1) / 0.01), 199) AS INTEGER) AS bin, similarity - exact AS d FROM j)
SELECT bin, count(*) AS n, round(avg(d), 6) AS bias, round(sqrt(avg(d * d)), 6) AS rms, round(CAST(bin AS DOUBLE) * 0.01 - 0.995, 6) AS center FROM d GROUP BY bin HAVING count(*) >= 2""",
    "lsh_bit_counts": f"WITH {_E}, {_sig_sql(LSH_BITS)} SELECT CAST(bit AS INTEGER) AS bit, CAST(sum(CAST(flag AS BIGINT)) AS BIGINT) AS set, CAST(sum(1 - CAST(flag AS BIGINT)) AS BIGINT) AS unset FROM flags GROUP BY bit",
    "signature_counts": f"WITH {_E}, {_sig_sql(16)} SELECT translate(t, '01', '_x') AS signature, count(*) AS n, min(id) AS first_id FROM sig GROUP BY t",
    "signature_size_histogram": f"""WITH {_E}, {_sig_sql(16)}, g AS (SELECT t, count(*) AS size FROM sig GROUP BY t), h AS (SELECT size, count(*) AS signatures, size * count(*) AS rows FROM g GROUP BY size)
SELECT size, signatures, rows, CAST(sum(rows) OVER (ORDER BY size) AS BIGINT) AS running FROM h""",
    "signature_graph_edges": f"""WITH {_E}, {_sig_sql(16)}, v AS (SELECT CAST(t AS BIT) AS t, min(id) AS id FROM sig GROUP BY t HAVING count(*) >= 2)
SELECT a.id AS src, b.id AS dst FROM v a JOIN v b ON a.id < b.id WHERE bit_count(xor(a.t, b.t)) = 1""",
    "signature_graph_categories": f"""WITH {_E}, {_M}, {_C}, {_TISSUE}, {_sig_sql(16)}, g AS (SELECT t, min(id) AS id, count(*) AS n FROM sig GROUP BY t HAVING count(*) >= 2)
SELECT g.id, coalesce(t.v, '') AS value, round(count(*) / any_value(g.n), 6) AS fraction FROM sig JOIN g ON g.t = sig.t LEFT JOIN t ON t.cell_id = sig.id GROUP BY g.id, coalesce(t.v, '')""",
    "knn_graph_connectivity": f"WITH {_C}, x AS {_edges_sql('ExactAllGenes')}, b AS (SELECT src AS id, similarity FROM x UNION ALL SELECT dst, similarity FROM x) SELECT CAST(id AS INTEGER) AS id, CAST(count(*) AS INTEGER) AS n, max(similarity) AS highest, min(similarity) AS lowest FROM b GROUP BY id",
    "graph_similarity_changes": f"""WITH {_C}, x AS {_edges_sql('ExactAllGenes')}, y AS {_edges_sql('Lsh1024AllGenes')}
SELECT round(round((y.similarity - x.similarity) / 0.01) * 0.01, 2) AS change, count(*) AS n FROM x JOIN y ON x.src = y.src AND x.dst = y.dst GROUP BY 1""",
    "label_propagation": _labels_sql(ITERATIONS),
    "connected_components": f"""WITH RECURSIVE {_C}, x AS {_edges_sql('ExactAllGenes')}, b AS (SELECT src AS id, dst AS other FROM x UNION SELECT dst, src FROM x),
reach AS (SELECT DISTINCT id, id AS other FROM b UNION SELECT reach.id, b.other FROM reach JOIN b ON reach.other = b.id)
SELECT id, min(other) AS component FROM reach GROUP BY id""",
    "cluster_graph": f"{_CLUSTERS} SELECT final.id, CAST(nums.num AS BIGINT) AS cluster_id FROM final LEFT JOIN nums ON nums.cl = final.cl",
    "cluster_graph_edges": f"""{_CLUSTERS},
links2 AS (SELECT DISTINCT least(a.num, b.num) AS c0, greatest(a.num, b.num) AS c1 FROM x JOIN final fa ON fa.id = x.src JOIN final fb ON fb.id = x.dst JOIN nums a ON a.cl = fa.cl JOIN nums b ON b.cl = fb.cl WHERE a.num <> b.num),
strong AS (SELECT c0, c1, sim FROM (SELECT l.c0, l.c1, {_PROFILE_SIMILARITY} AS sim FROM links2 l JOIN ps2 x0 ON x0.g = l.c0 JOIN ps2 y0 ON y0.g = l.c1
  LEFT JOIN (SELECT a.g AS g0, b.g AS g1, sum(a.a * b.a) AS xy FROM prof2 a JOIN prof2 b ON a.gene_id = b.gene_id GROUP BY a.g, b.g) xy ON xy.g0 = l.c0 AND xy.g1 = l.c1) WHERE sim >= 0.8),
ways AS (SELECT c0 AS v, c1 AS w, sim, c0, c1 FROM strong UNION ALL SELECT c1, c0, sim, c0, c1 FROM strong)
SELECT DISTINCT CAST(c0 AS BIGINT) AS c0, CAST(c1 AS BIGINT) AS c1, round(sim, 6) AS similarity FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY v ORDER BY sim DESC, w) AS r FROM ways) WHERE r <= 2""",
    "cluster_graph_profiles": f"{_CLUSTERS} SELECT CAST(g AS BIGINT) AS cluster_id, gene_id, round(a, 6) AS average FROM prof2",
    "vertex_tissue_frequencies": f"WITH {_M}, {_C}, {_TISSUE}, x AS {_edges_sql('ExactAllGenes')}, vert AS (SELECT src AS id FROM x UNION SELECT dst FROM x) SELECT t.v AS value, count(*) AS n FROM vert JOIN t ON t.cell_id = vert.id GROUP BY t.v",
    "vertex_category_colors": f"""WITH {_M}, {_C}, {_TISSUE}, x AS {_edges_sql('ExactAllGenes')}, vert AS (SELECT src AS id FROM x UNION SELECT dst FROM x),
f AS (SELECT t.v, ROW_NUMBER() OVER (ORDER BY count(*) DESC, t.v DESC) AS r FROM vert JOIN t ON t.cell_id = vert.id WHERE t.v <> '' GROUP BY t.v)
SELECT vert.id, t.v AS value, CASE WHEN f.r <= 12 THEN [{", ".join(f"'{c}'" for c in graphs.CATEGORY_COLORS)}][f.r] ELSE '#000000' END AS color FROM vert JOIN t ON t.cell_id = vert.id LEFT JOIN f ON f.v = t.v""",
    "vertex_expression_colors": f"""WITH {_E}, {_S}, {_C}, x AS {_edges_sql('ExactAllGenes')}, vert AS (SELECT src AS id FROM x UNION SELECT dst FROM x),
val AS (SELECT e.cell_id AS id, round(c / n2, 6) AS value FROM e JOIN s ON e.cell_id = s.cell_id WHERE gene_id = 26), {_scale_sql("(SELECT min(value) FROM val)", "(SELECT max(value) FROM val)")}""",
    "vertex_similarity_colors": f"""WITH {_E}, {_S}, {_C}, x AS {_edges_sql('ExactAllGenes')}, vert AS (SELECT src AS id FROM x UNION SELECT dst FROM x),
dot AS (SELECT b.cell_id AS id, sum(a.c * b.c) AS xy FROM e a JOIN e b ON a.gene_id = b.gene_id WHERE a.cell_id = 0 GROUP BY b.cell_id),
val AS (SELECT vert.id, round((1500 * coalesce(xy, 0) - a.s1 * b.s1) / sqrt((1500 * a.s2 - a.s1 * a.s1) * (1500 * b.s2 - b.s1 * b.s1)), 6) AS value
  FROM vert JOIN s b ON b.cell_id = vert.id JOIN s a ON a.cell_id = 0 LEFT JOIN dot ON dot.id = vert.id), {_scale_sql("0.0", "1.0")}""",
    "knn_graph_edges": f"WITH {_C}, x AS {_edges_sql('ExactAllGenes')} SELECT src, dst, similarity FROM x",
    "compare_graphs": f"""WITH {_C}, x AS {_edges_sql('ExactAllGenes')}, y AS {_edges_sql('Lsh1024AllGenes')},
vx AS (SELECT src AS id FROM x UNION SELECT dst FROM x), vy AS (SELECT src AS id FROM y UNION SELECT dst FROM y),
b AS (SELECT x.similarity AS s0, y.similarity AS s1 FROM x JOIN y ON x.src = y.src AND x.dst = y.dst)
SELECT (SELECT count(*) FROM vx) AS vertices0, (SELECT count(*) FROM vy) AS vertices1, (SELECT count(*) FROM vx WHERE id IN (SELECT id FROM vy)) AS common_vertices,
  (SELECT count(*) FROM x) AS edges0, (SELECT count(*) FROM y) AS edges1, (SELECT count(*) FROM b) AS common_edges, (SELECT count(*) FROM b WHERE s0 = s1) AS equal_edges""",
    "compare_pair_sets": f"""WITH x AS (SELECT id0, count(*) AS n, min(similarity) + 0.0 AS l FROM {_pairs_sql('ExactAllGenes')} p GROUP BY id0), y AS (SELECT id0, count(*) AS n, min(similarity) + 0.0 AS l FROM {_pairs_sql('Lsh1024AllGenes')} p GROUP BY id0),
b AS (SELECT coalesce(x.id0, y.id0) AS id0, coalesce(x.n, 0) AS count0, coalesce(x.l, 1) AS lowest0, coalesce(y.n, 0) AS count1, coalesce(y.l, 1) AS lowest1 FROM x FULL JOIN y ON x.id0 = y.id0)
SELECT id0, count0, lowest0, count1, lowest1 FROM b WHERE count0 <> count1 OR lowest0 <> lowest1""",
    "gene_report": f"WITH {_E}, {_S}, {_M}, {_C}, {_TISSUE} SELECT e.cell_id, round(c / n2, 6) AS value, t.v AS tissue FROM e JOIN s ON e.cell_id = s.cell_id JOIN t ON e.cell_id = t.cell_id WHERE gene_id = 26",
}

"""Problem 1: groups of mutually similar cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countgrid.llm.clusters import similarity_clusters
from countgrid.llm.queries_neighbours import cell_rows

#: Pairs within a group have a similarity of 0.42 or more, pairs across groups of 0.36 or less.
JOIN = 0.39
GROUP_CELLS = 5


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dims = cell_rows(spark, sf_dir)
    members, _ = similarity_clusters(rows, dims, join_similarity=JOIN, min_size=GROUP_CELLS)
    return members.select(F.col("cell_id").cast("int").alias("cell_id"), F.col("cluster_id").cast("int").alias("group_cell_id"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical cells of every group, also of those below ``GROUP_CELLS`` and of single cells."""
    rows, dims = cell_rows(spark, sf_dir)
    _, clusters = similarity_clusters(rows, dims, join_similarity=JOIN, min_size=1)
    return clusters.select(F.col("cluster_id").cast("int").alias("cluster_id"), "vertex_count", F.round("mean_similarity", 6).alias("mean_similarity"), F.element_at("typical_cells", 1).cast("int").alias("most_typical"), F.size("typical_cells").alias("typical"))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}
# Groups are cliques with nothing between them, so a group is what any one member is similar to.
_SIMILAR = """
WITH latest AS (
  SELECT cell_id, gene_id, CAST(expr_count AS DOUBLE) AS c,
         ROW_NUMBER() OVER (PARTITION BY cell_id, gene_id ORDER BY loaded_at DESC) AS r
  FROM expression_counts),
e AS (SELECT cell_id, gene_id, c FROM latest WHERE r = 1 AND c > 0 AND NOT isnan(c)),
s AS (SELECT cell_id, sum(c) AS s1, sum(c * c) AS s2 FROM e GROUP BY cell_id),
p AS (SELECT a.cell_id AS a, b.cell_id AS b, sum(a.c * b.c) AS xy FROM e a JOIN e b ON a.gene_id = b.gene_id AND a.cell_id <> b.cell_id GROUP BY a.cell_id, b.cell_id),
r AS (
  SELECT p.a, p.b, (1500 * xy - sa.s1 * sb.s1) / sqrt((1500 * sa.s2 - sa.s1 * sa.s1) * (1500 * sb.s2 - sb.s1 * sb.s1)) AS sim
  FROM p JOIN s sa ON sa.cell_id = p.a JOIN s sb ON sb.cell_id = p.b)"""

SQL = {
    "p1_found": _SIMILAR + "\nSELECT a AS cell_id, least(a, min(b)) AS group_cell_id FROM r WHERE sim >= 0.39 GROUP BY a HAVING count(*) >= 4",
    "p1_groups": _SIMILAR.replace("WITH latest", "WITH RECURSIVE latest") + """,
links AS (SELECT a, b FROM r WHERE sim >= 0.39),
reach AS (SELECT cell_id AS a, cell_id AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
own AS (SELECT a AS cell_id, min(b) AS g FROM reach GROUP BY a),
inside AS (SELECT x.cell_id, x.g, 1 + coalesce(sum(r.sim), 0) AS total FROM own x LEFT JOIN own y ON x.g = y.g AND x.cell_id <> y.cell_id LEFT JOIN r ON r.a = x.cell_id AND r.b = y.cell_id GROUP BY x.cell_id, x.g),
means AS (SELECT cell_id, g, total / count(*) OVER (PARTITION BY g) AS m FROM inside)
SELECT g AS cluster_id, count(*) AS vertex_count, round(avg(m), 6) AS mean_similarity, arg_min(cell_id, ROW(-round(m, 9), cell_id)) AS most_typical, CAST(least(count(*), 3) AS INTEGER) AS typical FROM means GROUP BY g""",
}

"""Problem 2: the best neighbours of every cell in every graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countgrid.llm.topn import top_n_per_group
from countgrid.session import read_table


def graph_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid directed pairs of every graph: latest similarity, at or above the graph's threshold."""
    pairs = read_table(spark, sf_dir, "similar_pairs")
    latest = pairs.groupBy("similar_pairs_name", "cell_id0", "cell_id1").agg(F.max(F.struct("computed_at", "similarity")).alias("last"))
    latest = latest.select("similar_pairs_name", "cell_id0", "cell_id1", F.col("last.similarity").alias("similarity"))
    latest = latest.filter("similarity IS NOT NULL AND NOT isnan(similarity) AND cell_id0 != cell_id1")
    graphs = read_table(spark, sf_dir, "cell_graph_information").select("graph_id", "similar_pairs_name", "similarity_threshold", "max_connectivity").distinct()
    both = latest.join(graphs, "similar_pairs_name").filter("cast(similarity as double) >= similarity_threshold")
    return both.select("graph_id", "cell_id0", "cell_id1", "similarity", "max_connectivity")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_n_per_group(graph_candidates(spark, sf_dir), ["graph_id", "cell_id0"], "similarity", "cell_id1", "max_connectivity")
    return top.select("graph_id", "cell_id0", "cell_id1")


QUERIES = {"p2_found": p2_found}

SQL = {
    "p2_found": """
WITH latest AS (
  SELECT similar_pairs_name, cell_id0, cell_id1, similarity,
         ROW_NUMBER() OVER (PARTITION BY similar_pairs_name, cell_id0, cell_id1 ORDER BY computed_at DESC) AS r
  FROM similar_pairs),
valid AS (
  SELECT * FROM latest WHERE r = 1 AND similarity IS NOT NULL AND NOT isnan(similarity) AND cell_id0 <> cell_id1),
graphs AS (
  SELECT DISTINCT graph_id, similar_pairs_name, similarity_threshold, max_connectivity FROM cell_graph_information),
ranked AS (
  SELECT g.graph_id, v.cell_id0, v.cell_id1, g.max_connectivity,
         ROW_NUMBER() OVER (PARTITION BY g.graph_id, v.cell_id0 ORDER BY v.similarity DESC, v.cell_id1) AS k
  FROM valid v JOIN graphs g ON v.similar_pairs_name = g.similar_pairs_name
  WHERE v.similarity >= g.similarity_threshold)
SELECT graph_id, cell_id0, cell_id1 FROM ranked WHERE k <= max_connectivity""",
}

"""Problem 3: the most similar cells of every cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countgrid.llm.neighbours import nearest_rows
from countgrid.operators import similarity
from countgrid.operators.matrix import latest_counts, packed_rows
from countgrid.session import Scratch, read_table

NEIGHBOURS = 5


def cell_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Every cell as a packed row, and the number of genes."""
    dims = (read_table(spark, sf_dir, "genes").agg(F.max("gene_id")).first()[0] or 0) + 1
    rows = packed_rows(latest_counts(read_table(spark, sf_dir, "expression_counts")))
    return Scratch(spark, "rows").keep(rows), dims


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dims = cell_rows(spark, sf_dir)
    return nearest_rows(rows, dims, NEIGHBOURS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = Scratch(spark, "near").keep(neighbours(spark, sf_dir).filter("similarity >= 0.98").select("cell_id", "other_id"))
    there = near.filter("cell_id < other_id").select(F.col("cell_id").alias("cell_id0"), F.col("other_id").alias("cell_id1"))
    back = near.filter("cell_id > other_id").select(F.col("other_id").alias("cell_id0"), F.col("cell_id").alias("cell_id1"))
    both = there.join(back, ["cell_id0", "cell_id1"])
    return both.select(F.col("cell_id0").cast("int").alias("cell_id0"), F.col("cell_id1").cast("int").alias("cell_id1"))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of the stated query set: every cell whose id is divisible by 20, against all cells."""
    return neighbours(spark, sf_dir).filter("cell_id % 20 = 0")


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the neighbours of the query set hold at least 0.9 of the true ones, by comparison with all cells."""
    rows, dims = cell_rows(spark, sf_dir)
    near = Scratch(spark, "near").keep(nearest_rows(rows, dims, NEIGHBOURS).filter("cell_id % 20 = 0"))
    asked = rows.filter("cell_id % 20 = 0")
    true = Scratch(spark, "true").keep(similarity.top_k(similarity.query_pairs(asked, rows, dims, NEIGHBOURS), NEIGHBOURS))
    least = true.groupBy("id0").agg(F.min("similarity").alias("least"), F.count(F.lit(1)).alias("n"))
    # of equally similar cells any is a true neighbour
    hits = near.join(least, F.col("cell_id") == F.col("id0")).filter(F.col("similarity") >= F.col("least") - 1e-9).agg(F.count(F.lit(1)).alias("hits"))
    total = least.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("cells"))
    return total.join(hits).select("cells", (F.col("hits") >= 0.9 * F.col("total")).alias("recall_reached"))


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours, "p3_recall": p3_recall}

SQL = {
    "p3_recall": """
WITH latest AS (SELECT cell_id, gene_id, expr_count AS c, ROW_NUMBER() OVER (PARTITION BY cell_id, gene_id ORDER BY loaded_at DESC) AS r FROM expression_counts)
SELECT count(DISTINCT cell_id) AS cells, true AS recall_reached FROM latest WHERE r = 1 AND c > 0 AND NOT isnan(c) AND cell_id % 20 = 0""",
    "p3_found": """
WITH latest AS (
  SELECT cell_id, gene_id, CAST(expr_count AS DOUBLE) AS c,
         ROW_NUMBER() OVER (PARTITION BY cell_id, gene_id ORDER BY loaded_at DESC) AS r
  FROM expression_counts),
e AS (SELECT cell_id, gene_id, c FROM latest WHERE r = 1 AND c > 0 AND NOT isnan(c)),
s AS (SELECT cell_id, sum(c) AS s1, sum(c * c) AS s2 FROM e GROUP BY cell_id),
p AS (SELECT a.cell_id AS a, b.cell_id AS b, sum(a.c * b.c) AS xy FROM e a JOIN e b ON a.gene_id = b.gene_id AND a.cell_id <> b.cell_id GROUP BY a.cell_id, b.cell_id),
r AS (
  SELECT p.a, p.b, round((1500 * xy - sa.s1 * sb.s1) / sqrt((1500 * sa.s2 - sa.s1 * sa.s1) * (1500 * sb.s2 - sb.s1 * sb.s1)), 9) AS sim
  FROM p JOIN s sa ON sa.cell_id = p.a JOIN s sb ON sb.cell_id = p.b),
k AS (SELECT a, b, sim, ROW_NUMBER() OVER (PARTITION BY a ORDER BY sim DESC, b) AS n FROM r)
SELECT x.a AS cell_id0, x.b AS cell_id1 FROM k x JOIN k y ON x.a = y.b AND x.b = y.a
WHERE x.n <= 5 AND y.n <= 5 AND x.sim >= 0.98 AND x.a < x.b""",
}

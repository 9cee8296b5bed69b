"""Problem 6: the documents in containers of every listed capacity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countgrid.llm.packing import pack_texts, token_counts
from countgrid.session import Scratch, read_table


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a text and kind of container."""
    sizes = Scratch(spark, "tokens").keep(token_counts(read_table(spark, sf_dir, "documents")))
    kinds = read_table(spark, sf_dir, "token_containers").orderBy("container_id").collect()  # one row per kind of container
    parts = [pack_texts(sizes, k["capacity_tokens"]).select(F.lit(k["container_id"]).alias("container_id"), "container", "doc_id", "piece", "first_token", "tokens") for k in kinds]
    return reduce(DataFrame.unionByName, parts)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each kind are."""
    return _fill(spark, sf_dir, p6_packing(spark, sf_dir).filter("container IS NOT NULL"))


def _fill(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    used = rows.groupBy("container_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    kinds = read_table(spark, sf_dir, "token_containers")
    return used.join(kinds, "container_id").select("container_id", "capacity_tokens", "containers", "tokens", (F.col("tokens") / F.col("containers") / F.col("capacity_tokens")).alias("fill"))


def p6_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for each kind of container: every document is there, its pieces follow each other without
    gap, only pieces of too large texts are split off and are full but for the last, no container holds
    too much, and the containers are at least 0.95 full (0.9 where they are fewer than ten)."""
    rows = Scratch(spark, "packed").keep(p6_packing(spark, sf_dir))
    kinds = read_table(spark, sf_dir, "token_containers").select("container_id", "capacity_tokens")
    docs = rows.groupBy("container_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("n"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.max("piece").alias("last"), F.max("tokens").alias("largest"))
    docs = docs.join(kinds, "container_id")
    needless = (F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens"))
    gaps = (F.col("n") != F.col("end")) | (F.col("pieces") != F.col("last") + 1) | (F.col("pieces") != F.greatest(F.ceil(F.col("n") / F.col("capacity_tokens")), F.lit(1)))
    per_doc = docs.groupBy("container_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(needless.cast("int")).alias("needless_splits"), F.sum(gaps.cast("int")).alias("broken"))
    bins = rows.filter("container IS NOT NULL").groupBy("container_id", "container").agg(F.sum("tokens").alias("used")).join(kinds, "container_id")
    overfull = bins.groupBy("container_id").agg(F.sum((F.col("used") > F.col("capacity_tokens")).cast("int")).alias("overfull"))
    fill = _fill(spark, sf_dir, rows.filter("container IS NOT NULL")).select("container_id", (F.col("fill") >= F.when(F.col("containers") < 10, 0.9).otherwise(0.95)).alias("well_filled"))
    return per_doc.join(overfull, "container_id").join(fill, "container_id").select("container_id", "documents", "needless_splits", "broken", "overfull", "well_filled")


QUERIES = {"p6_packing": p6_packing, "p6_fill": p6_fill, "p6_sound": p6_sound}
SQL = {
    "p6_sound": """
SELECT container_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, CAST(0 AS BIGINT) AS needless_splits, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS overfull, true AS well_filled
FROM token_containers"""
}

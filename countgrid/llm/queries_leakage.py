"""Problem 7: documents that hold passages of evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countgrid.llm.leakage import find_leaks
from countgrid.session import read_table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"), min_similarity=1.0)
    return leaks.select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item that leaked, with its suite and the number of documents that hold a part of it."""
    found = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return read_table(spark, sf_dir, "eval_items").select("item_id", "suite").distinct().join(found, "item_id")


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with copies of items, also edited ones: item-sized windows of a shingle similarity of 0.8 or more."""
    leaks = find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"), window=None)
    return leaks.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items, "p7_near": p7_near}

_FOUND = """
WITH texts AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
items AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
runs AS (SELECT doc_id, array_to_string(w[i:i+11], ' ') AS run FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM texts)),
passages AS (SELECT item_id, array_to_string(w[i:i+11], ' ') AS run FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM items)),
found AS (SELECT DISTINCT doc_id, item_id FROM runs JOIN passages ON runs.run = passages.run)"""

SQL = {
    "p7_found": _FOUND + "\nSELECT doc_id, item_id FROM found",
    "p7_items": _FOUND + "\nSELECT e.item_id, e.suite, count(*) AS documents FROM (SELECT DISTINCT item_id, suite FROM eval_items) e JOIN found ON e.item_id = found.item_id GROUP BY e.item_id, e.suite",
}

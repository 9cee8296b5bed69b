"""Problem 8: quality statistics of every document and the layouts that are no prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countgrid.llm.quality import COMMON_WORDS, text_quality
from countgrid.session import read_table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(read_table(spark, sf_dir, "documents")).filter("layout IS NOT NULL").select("doc_id", "layout")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = text_quality(read_table(spark, sf_dir, "documents"))
    return stats.select("doc_id", "words", F.round("mean_word_length", 6).alias("mean_word_length"), F.round("common_word_share", 6).alias("common_word_share"), "common_words")


def p8_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the measures and the rules it fails."""
    return text_quality(read_table(spark, sf_dir, "documents"))


QUERIES = {"p8_found": p8_found, "p8_statistics": p8_statistics, "p8_reasons": p8_reasons}

_COMMON = ", ".join("'" + w + "'" for w in dict.fromkeys(COMMON_WORDS))
SQL = {
    "p8_statistics": f"""
WITH texts AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word FROM texts),
sums AS (
  SELECT doc_id, count(*) AS n, sum(length(word)) AS chars,
         sum(CASE WHEN word IN ({_COMMON}) THEN 1 ELSE 0 END) AS common,
         count(DISTINCT CASE WHEN word IN ({_COMMON}) THEN word END) AS kinds
  FROM words GROUP BY doc_id)
SELECT t.doc_id, coalesce(s.n, 0) AS words, round(coalesce(s.chars / s.n, 0), 6) AS mean_word_length,
       round(coalesce(s.common / s.n, 0), 6) AS common_word_share, coalesce(s.kinds, 0) AS common_words
FROM texts t LEFT JOIN sums s ON t.doc_id = s.doc_id""",
}

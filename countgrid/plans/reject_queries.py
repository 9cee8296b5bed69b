"""Problem 4: raw lines that can't be read, with the reason, and the others typed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from countgrid.operators.reject import count_rows, parse_lines, typed_meta
from countgrid.plans.pivot_queries import declared_types
from countgrid.session import read_table


def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(read_table(spark, sf_dir, "raw_lines"), read_table(spark, sf_dir, "raw_files"), declared_types(spark, sf_dir, "cell"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_lines(spark, sf_dir).filter("reason IS NOT NULL").select("line_id", "reason")


def p4_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_meta(parsed_lines(spark, sf_dir))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rows(parsed_lines(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_meta": p4_meta, "p4_counts": p4_counts}
_NUMBER = "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"
_JUDGED = f"""
WITH once AS (
  SELECT line_id, any_value(file_id) AS file_id, any_value(line_no) AS line_no, any_value(raw_line) AS raw_line
  FROM raw_lines WHERE line_id IS NOT NULL AND file_id IS NOT NULL GROUP BY line_id),
shaped AS (
  SELECT l.line_id, l.file_id, l.line_no, f.file_kind, f.n_fields, f.separator_chars AS s,
         ltrim(regexp_replace(coalesce(l.raw_line, ''), '\r$', ''), '﻿') AS t,
         CASE WHEN contains(f.separator_chars, chr(9)) THEN '[ ]*' ELSE '[ \t]*' END AS b
  FROM once l JOIN raw_files f ON l.file_id = f.file_id),
formed AS (SELECT *, '(?:' || b || '"(?:[^"\\\\]|\\\\["\\\\])*"' || b || '|[^"\\\\' || s || ']*)' AS field FROM shaped),
split AS (
  SELECT *, regexp_full_match(t, field || '(?:[' || s || ']' || field || ')*') AS sound,
         regexp_extract_all(t || substr(s, 1, 1), field || '[' || s || ']') AS parts
  FROM formed),
each AS (
  SELECT line_id, file_id, line_no, file_kind, n_fields, len(parts) AS n, i, trim(left(parts[i], length(parts[i]) - 1), ' \t') AS v
  FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM split WHERE sound)),
clean AS (
  SELECT line_id, file_id, line_no, file_kind, n_fields, n, i,
         CASE WHEN v LIKE '"%' THEN trim(regexp_replace(substr(v, 2, length(v) - 2), '\\\\(["\\\\])', '\\1', 'g'), ' \t') ELSE v END AS v
  FROM each),
names AS (
  SELECT file_id, CASE WHEN n = n_fields THEN i ELSE i + 1 END AS i, lower(trim(v, ' \t')) AS name FROM clean WHERE line_no = 1),
kinds AS (SELECT DISTINCT lower(trim(field_name, ' \t')) AS name, value_type FROM meta_fields WHERE entity = 'cell'),
typed AS (SELECT names.file_id, names.i, coalesce(kinds.value_type, 'string') AS kind FROM names LEFT JOIN kinds ON names.name = kinds.name),
judged AS (
  SELECT c.line_id,
    CASE
      WHEN c.i = 1 THEN c.v = ''
      WHEN c.file_kind = 'ExpressionMatrix' THEN NOT regexp_full_match(c.v, '{_NUMBER}') OR coalesce(TRY_CAST(c.v AS DOUBLE) < 0, false)
      WHEN c.v = '' OR lower(c.v) IN ('na', 'n/a', 'null', '-', '?') THEN false
      WHEN t.kind = 'integer' THEN NOT regexp_full_match(c.v, '[+-]?[0-9]+')
      WHEN t.kind = 'decimal' THEN NOT regexp_full_match(c.v, '{_NUMBER}')
      WHEN t.kind = 'boolean' THEN lower(c.v) NOT IN ('true', 'yes', '1', 'false', 'no', '0')
      WHEN t.kind = 'date' THEN NOT regexp_full_match(c.v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR c.v LIKE '0000%' OR TRY_CAST(c.v AS DATE) IS NULL
      ELSE false
    END AS bad
  FROM clean c LEFT JOIN typed t ON c.file_id = t.file_id AND c.i = t.i),
bad AS (SELECT line_id, bool_or(bad) AS bad FROM judged GROUP BY line_id),
reasons AS (
  SELECT s.line_id, CASE WHEN NOT s.sound THEN 'quoting' WHEN len(s.parts) <> s.n_fields THEN 'column_count' WHEN bad.bad THEN 'value' END AS reason
  FROM split s LEFT JOIN bad ON s.line_id = bad.line_id WHERE s.line_no IS NULL OR s.line_no <> 1)"""
_VALID = """,
headed AS (SELECT file_id, CASE WHEN n = n_fields THEN i ELSE i + 1 END AS i, v AS label FROM clean WHERE line_no = 1),
valid AS (SELECT c.line_id, c.file_id, c.file_kind, c.i, c.v, f.v AS first, h.label FROM clean c JOIN reasons r ON r.line_id = c.line_id AND r.reason IS NULL
  JOIN clean f ON f.line_id = c.line_id AND f.i = 1 LEFT JOIN headed h ON h.file_id = c.file_id AND h.i = c.i WHERE c.i > 1)"""

SQL = {
    "p4_found": _JUDGED + "\nSELECT line_id, reason FROM reasons WHERE reason IS NOT NULL",
    "p4_meta": f"""{_JUDGED}{_VALID},
held AS (SELECT v.file_id, v.line_id, v.first AS cell_name, lower(trim(v.label, ' \t')) AS field, coalesce(t.kind, 'string') AS value_type,
    CASE WHEN v.v <> '' AND lower(v.v) NOT IN ('na', 'n/a', 'null', '-', '?') THEN v.v END AS x
  FROM valid v LEFT JOIN typed t ON t.file_id = v.file_id AND t.i = v.i WHERE v.file_kind = 'MetaData')
SELECT file_id, line_id, cell_name, field, value_type,
  CASE WHEN value_type = 'string' THEN x END AS string_value,
  CASE WHEN value_type = 'integer' THEN TRY_CAST(x AS DECIMAL(38,0)) END AS integer_value,
  CASE WHEN value_type = 'decimal' THEN TRY_CAST(x AS DOUBLE) END AS decimal_value,
  CASE WHEN value_type = 'boolean' THEN lower(x) IN ('true', 'yes', '1') END AS boolean_value,
  CASE WHEN value_type = 'date' THEN TRY_CAST(x AS DATE) END AS date_value
FROM held""",
    "p4_counts": f"""{_JUDGED}{_VALID}
SELECT file_id, line_id, first AS gene_name, label AS cell_name, TRY_CAST(v AS DOUBLE) AS count FROM valid WHERE file_kind = 'ExpressionMatrix' AND TRY_CAST(v AS DOUBLE) > 0""",
}

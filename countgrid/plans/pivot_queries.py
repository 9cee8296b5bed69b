"""Problem 5: the meta data of cells and genes as wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countgrid.functions.values import canonical, field_key
from countgrid.operators.pivot import pivot_wide, quoted, wide_name
from countgrid.session import read_table


def declared_types(spark: SparkSession, sf_dir: str, entity: str) -> dict[str, str]:
    """Field types of one entity; the table holds one row per declared column."""
    rows = read_table(spark, sf_dir, "meta_fields").filter(F.col("entity") == entity).collect()
    return {r["field_name"].strip(" \t").lower(): r["value_type"] for r in rows}


def wide_meta(spark: SparkSession, sf_dir: str, entity: str) -> tuple[DataFrame, dict[str, str]]:
    rows = read_table(spark, sf_dir, f"{entity}_meta_data")
    return pivot_wide(rows, declared_types(spark, sf_dir, entity), entity=f"{entity}_id")


def long_form(wide: DataFrame, kinds: dict[str, str], entity: str) -> DataFrame:
    """The non-null cells of a wide table."""
    fields = list(kinds)
    texts = wide.select("entity_id", F.array(*[F.struct(F.lit(f).alias("field"), canonical(F.col(quoted(wide_name(f))), kinds[f]).alias("typed_value")) for f in fields]).alias("cells"))
    texts = texts.select("entity_id", F.explode("cells").alias("cell")).filter("cell.typed_value IS NOT NULL")
    return texts.select(F.lit(entity).alias("entity"), "entity_id", "cell.field", "cell.typed_value")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, genes = (long_form(*wide_meta(spark, sf_dir, e), e) for e in ("cell", "gene"))
    return cells.unionByName(genes)


def p5_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by the fields of each plate: hundreds of columns. The number of cells is that of non-null values per column."""
    plates = read_table(spark, sf_dir, "cells").groupBy("cell_id").agg(F.max(F.struct("loaded_at", "cell_name", "plate_name")).getField("plate_name").alias("plate"))
    rows = read_table(spark, sf_dir, "cell_meta_data").join(plates, "cell_id")
    rows = rows.withColumn("meta_name", F.concat(F.coalesce("plate", F.lit("")), F.lit("/"), field_key(F.col("meta_name"))))
    wide, kinds = pivot_wide(rows, {})
    return long_form(wide, kinds, "cell").groupBy("field").agg(F.count(F.lit(1)).alias("cells"), F.min("typed_value").alias("least"), F.max("typed_value").alias("greatest"))


QUERIES = {"p5_found": p5_found, "p5_plates": p5_plates}

_ENTITY = """
SELECT '{e}' AS entity, {e}_id AS entity_id, lower(trim(meta_name, ' \t')) AS field, trim(meta_value, ' \t') AS v,
       ROW_NUMBER() OVER (PARTITION BY {e}_id, lower(trim(meta_name, ' \t')) ORDER BY loaded_at DESC, ord DESC, meta_value DESC NULLS LAST) AS r
FROM {e}_meta_data"""

SQL = {
    "p5_plates": f"""
WITH plates AS (SELECT cell_id, coalesce(plate_name, '') AS plate FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC, cell_name DESC, plate_name DESC NULLS LAST) AS r FROM cells) WHERE r = 1),
rows AS ({_ENTITY.format(e="cell")}),
held AS (SELECT lower(plate || '/' || field) AS field, v FROM rows JOIN plates ON plates.cell_id = rows.entity_id WHERE r = 1 AND v IS NOT NULL AND v <> '' AND lower(v) NOT IN ('na', 'n/a', 'null', '-', '?'))
SELECT field, count(*) AS cells, min(v) AS least, max(v) AS greatest FROM held GROUP BY field""",
    "p5_found": f"""
WITH rows AS ({_ENTITY.format(e="cell")} UNION ALL {_ENTITY.format(e="gene")}),
kinds AS (SELECT DISTINCT entity, lower(trim(field_name, ' \t')) AS field, value_type FROM meta_fields),
held AS (
  SELECT rows.entity, rows.entity_id, rows.field, rows.v, coalesce(kinds.value_type, 'string') AS kind
  FROM rows LEFT JOIN kinds ON rows.entity = kinds.entity AND rows.field = kinds.field
  WHERE r = 1 AND v IS NOT NULL AND v <> '' AND lower(v) NOT IN ('na', 'n/a', 'null', '-', '?')),
texts AS (
  SELECT entity, entity_id, field,
    CASE kind
      WHEN 'string' THEN v
      WHEN 'integer' THEN CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN CAST(CAST(v AS DECIMAL(38,0)) AS VARCHAR) END
      WHEN 'decimal' THEN CASE WHEN regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN printf('%.3f', CAST(v AS DOUBLE)) END
      WHEN 'boolean' THEN CASE WHEN lower(v) IN ('true', 'yes', '1') THEN 'true' WHEN lower(v) IN ('false', 'no', '0') THEN 'false' END
      WHEN 'date' THEN CASE WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND v NOT LIKE '0000%' AND TRY_CAST(v AS DATE) IS NOT NULL THEN v END
    END AS typed_value
  FROM held)
SELECT entity, entity_id, field, typed_value FROM texts WHERE typed_value IS NOT NULL""",
}

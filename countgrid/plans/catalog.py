"""All queries of the core with their SQL counterparts."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

_MODULES = ["matrix_queries", "pivot_queries", "reject_queries", "store_queries"]

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in _MODULES:
    _module = importlib.import_module(f"countgrid.plans.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["topk_similar_cells"](spark, sf_dir)

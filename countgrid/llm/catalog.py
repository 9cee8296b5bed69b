"""All queries of this subpackage with their SQL counterparts."""

from __future__ import annotations

import importlib

_MODULES = ["queries_topn", "queries_leakage", "queries_quality", "queries_neighbours", "queries_clusters", "queries_packing"]

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in _MODULES:
    _module = importlib.import_module(f"countgrid.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL

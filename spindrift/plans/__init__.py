"""Catalogue of the engine's queries and of their SQL counterparts.

Each module holds ``QUERIES`` (name to ``(spark, base) -> DataFrame``) and ``SQL`` (name to DuckDB text).
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("packed", "datasets", "store", "web", "search")


def collect() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql

"""Registry of queries over the driver tables: name → (builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, tuple[Builder, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query builder; ``sql`` is its DuckDB oracle (``None`` → rows-only check)."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn
    return deco

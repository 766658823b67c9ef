"""All queries by name, with the equivalent SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "flagship_msi_top5"


def query(name: str, sql: str | None = None) -> Callable:
    def note(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return note


from . import model_queries, table_queries  # noqa: E402, F401  they fill the registry

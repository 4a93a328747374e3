"""Registered queries and the DuckDB SQL of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.sources.tables import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, more: str = "", recursive: bool = False) -> Callable:
    """Register a query under its function's name. ``sql`` selects from det, cam and face; ``more`` adds views before it, which
    may go row by row over themselves where ``recursive``."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{SQL}{', ' + more if more else ''} {sql}"
        return f

    return put

"""Queries by name, each with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def values(rows: list[tuple], names: str) -> str:
    """A VALUES table for DuckDB."""

    def lit(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, list):
            return "[" + ", ".join(map(lit, x)) + "]" + ("::VARCHAR[]" if x and isinstance(x[0], str) else "::BIGINT[]")
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS {names}"

"""Registered queries and the SQL that must give the same rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def r(expression: str, digits: int, name: str) -> str:
    """Rounded SQL column; adding 0.0 turns a negative zero into zero."""
    return f"round({expression}, {digits}) + 0.0 AS {name}"

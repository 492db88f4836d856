"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``check`` is its equivalent SQL, if there is one."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"Consulta repetida: {name}")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn
    return add

"""Registered queries: each runs an operator over whole tables.

A query that SQL can express carries the equivalent statement, written
independently of the Spark formulation, for checking results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where one exists, its check statement."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECK_SQL[name] = sql
        return fn
    return add


def load_all() -> None:
    """Import the modules that register queries."""
    from flowsieve.queries import (  # noqa: F401
        cleaning, evaluation, learning, neighbors, properties, sampling, sources,
    )

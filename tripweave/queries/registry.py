"""Registry of bound queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(covers: str, sql: str | None = None):
    """Register a function under its own name. ``covers`` lists operator ids."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if fn.__name__ in QUERIES:
            raise ValueError(f"duplicate query {fn.__name__}")
        QUERIES[fn.__name__] = fn
        COVERS[fn.__name__] = covers.split()
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add

"""Queries of this package and their SQL, filled by the modules at import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name with its oracle SQL."""
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def load() -> None:
    from . import (alignment, compression, decontaminate, neardup, packing, pieces, pii, roles, rules, tokenfile, toxicity,  # noqa: F401
                   urls, vectorcodes)

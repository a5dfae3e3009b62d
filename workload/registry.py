"""Registry of queries and their checking SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn
    return add


def num(column: str | Column, name: str | None = None, places: int = 6) -> Column:
    """A double rounded for comparison; minus zero becomes zero."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c.cast("double"), places) + F.lit(0.0)
    return out.alias(name or column)


def when(column: str | Column, name: str | None = None) -> Column:
    """A time as text, the same in every engine."""
    c = F.col(column) if isinstance(column, str) else column
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name or column)


def whole(column: str | Column, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("bigint").alias(name or column)

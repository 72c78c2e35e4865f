"""Where the catalog modules put their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def joined(arr: Column, sep: str = "|") -> Column:
    """Arrays leave a registered query as one string."""
    return F.coalesce(F.array_join(arr, sep), F.lit(""))


def sql_joined(arr: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string({arr}, '{sep}'), '')"


def big(c: Column) -> Column:
    return c.cast("bigint")

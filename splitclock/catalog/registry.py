"""Where the named queries and their check SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that must give the same rows where there is one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def with_ctes(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Round every double column, so that sums in another order compare equal; ``other`` names columns with digits
    of their own."""
    cols: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f.name)
        real = isinstance(f.dataType, (T.DoubleType, T.FloatType))
        cols.append(F.round(c, other.get(f.name, digits)).alias(f.name) if real else c)
    return df.select(*cols)

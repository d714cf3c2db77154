"""Registered queries on the shared test tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function ``(spark, folder) -> DataFrame`` under its own name."""
    def add(function):
        key = name or function.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} exists")
        QUERIES[key] = function
        if sql:
            SQL[key] = sql
        return function
    return add


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """All doubles rounded, all integers as BIGINT: the form compared with the SQL."""
    out = []
    for name, kind in df.dtypes:
        column: Column = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            # adding 0.0 turns -0.0 into 0.0
            column = (F.round(column.cast("double"), special.get(name, digits)) + F.lit(0.0)).alias(name)
        elif kind in ("int", "smallint", "tinyint", "bigint"):
            column = column.cast("bigint").alias(name)
        out.append(column)
    return df.select(*out)


def load() -> None:
    """Import every module that registers queries."""
    from supplylens.registry import (  # noqa: F401
        analysis, cleaning, exports, expressions, ingest, joins, pivots, planning, statistics, texts,
    )

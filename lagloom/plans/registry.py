"""Named analyses: a function of (spark, folder) and, where one exists, the
SQL text that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Analysis = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Analysis] = {}
ORACLE: dict[str, str] = {}


def analysis(sql: str | None = None, name: str | None = None):
    def add(fn: Analysis) -> Analysis:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return add


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)

"""Registry of named queries: Spark builder + optional DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairos.plans.oracle import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None, extra_views: dict[str, str] | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is the DuckDB body; the fixture views it names are prepended.
    ``None`` marks a query without an SQL equivalent (rows-only check).
    """

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            ORACLE[name] = with_views(sql.strip(), extra_views)
        return fn

    return deco


def r(c, digits: int = 4) -> Column:
    """Round a double at the edge so both engines hash the same text."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)

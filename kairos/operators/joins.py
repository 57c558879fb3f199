"""Joins: equi, semi/anti, as-of, nearest, interval self-join, lookups.

Broadcast is used only for sides whose size is bounded by construction
(a landmark grid, a top-k table); everything else is left to the planner
(broadcast by size, sort-merge join, AQE skew splitting).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def equi_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Inner or left equi join; duplicate right keys multiply rows."""
    return left.join(right, list(on), how)


def semi(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """C4: rows of ``left`` with a match in ``right``."""
    return left.join(right.select(*on), list(on), "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """C4: rows of ``left`` without a match in ``right``."""
    return left.join(right.select(*on), list(on), "left_anti")


def landmark_rows(df: DataFrame, landmarks: Sequence[float], out: str = "landmark") -> DataFrame:
    """Every row repeated once per landmark (grid is a literal array, not a table)."""
    return df.withColumn(out, F.explode(F.array(*[F.lit(float(x)) for x in landmarks])))


def nearest_landmark(c, landmarks: Sequence[float]) -> F.Column:
    """The landmark closest to ``c``; the first (smallest) on ties."""
    arr = F.array(*[F.struct(F.abs(F.col(c) - F.lit(float(x))).alias("d"), F.lit(float(x)).alias("l"))
                    for x in landmarks])
    return F.array_min(arr)["l"]


def drop_close_followers(df: DataFrame, *, key: str, time: str, days: int = 14,
                         bucket_days: int = 365) -> DataFrame:
    """Drop a row when another row of the same key is 0..days-1 days earlier.

    Rows are distinct per (key, day); every later member of a chain is
    dropped because the test is against the undropped table, so the nearest
    earlier row decides. That row is found by ``lag`` inside (key, year
    bucket); the first row of a bucket takes the last day of the key's
    previous non-empty bucket from a small per-(key, bucket) table, so a key
    with a very long history is spread over many tasks.
    """
    d = df.dropDuplicates([key, time]).withColumn("_bk", F.floor(F.unix_date(F.col(time)) / F.lit(bucket_days)))
    last = d.groupBy(key, "_bk").agg(F.max(time).alias("_last"))
    carry = last.select(key, "_bk", F.lag("_last").over(Window.partitionBy(key).orderBy("_bk")).alias("_carry"))
    w = Window.partitionBy(key, "_bk").orderBy(time)
    d = d.withColumn("_prev", F.lag(time).over(w)).join(carry, [key, "_bk"])
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    return (d.filter(prev.isNull() | (F.datediff(F.col(time), prev) >= days))
            .drop("_prev", "_carry", "_bk"))


def top_groups_lookup(df: DataFrame, group: str, k: int = 12, out: str = "group_rank") -> DataFrame:
    """Groups ranked by size (ties by id); the top ``k`` keep their rank, the rest share ``k+1``.

    The top ``k`` come from ``orderBy(...).limit(k)`` (a distributed
    take-ordered: per-partition top k, then a merge); the ranking table has
    at most ``k`` rows, so broadcasting it is safe.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    top = sizes.orderBy(F.col("_n").desc(), F.col(group).asc()).limit(k)
    w = Window.orderBy(F.col("_n").desc(), F.col(group).asc())
    ranked = top.select(group, F.row_number().over(w).cast("int").alias(out))
    return (df.join(F.broadcast(ranked), group, "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(k + 1))))


def enrich_codes(df: DataFrame, codes: DataFrame, *, code: str, order: Sequence[str],
                 keep: Sequence[str]) -> DataFrame:
    """C11: left join a description table after keeping one row per code."""
    first = F.struct(*[F.col(c) for c in order])
    one = codes.groupBy(code).agg(*[F.min_by(F.struct(F.col(c)), first)[c].alias(c) for c in keep])
    return df.join(one, code, "left")

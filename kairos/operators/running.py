"""Distributed running sums and global ranks.

A ``Window.orderBy`` without ``partitionBy`` moves every row into one task.
These helpers compute the same values with the data spread out:

1. each row gets a **bucket**: a deterministic, monotone function of its
   order key (bounds from a hash-ordered sample of the key's values, or a caller-given
   expression such as ``floor(day / 32)``), so buckets follow the order,
2. inside each (group, bucket) a windowed running sum,
3. per-(group, bucket) totals (a table bounded by groups x buckets) turned
   into offsets by a window over that small table and joined back.

The bucket is a plain expression with literal bounds, not a partition id:
every branch of the plan and every recomputed task sees the same buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_BUCKETS = 64


def _n_buckets(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    try:
        return max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    except Exception:  # noqa: BLE001
        return DEFAULT_BUCKETS


#: Values sampled per bucket when bucket bounds are chosen.
SAMPLE_PER_BUCKET = 32


def bucket_bounds(df: DataFrame, c: str, n: int) -> Column:
    """Bounds of n buckets of column ``c`` in its natural order (any orderable type), as a sorted array.

    The bounds are every 32nd of the ``32 n`` distinct values with the smallest
    hashes: a sample that depends on the values alone, so every branch of a
    plan and every retried task sees the same buckets. It is a scalar subquery
    of the plan (take-ordered, ``32 n`` rows), not a job of its own, and whole
    values are compared, so strings with a long common prefix are split too.
    """
    per = SAMPLE_PER_BUCKET
    sample = (df.select(F.col(c).alias("_v")).filter(F.col("_v").isNotNull()).distinct()
              .orderBy(F.xxhash64("_v"), "_v").limit(per * n))
    every = F.array_sort(F.collect_list("_v"))
    return sample.agg(F.filter(every, lambda x, i: i % per == per - 1).alias("_b")).scalar()


def running_sum(df: DataFrame, order_cols: list[str], sum_cols: list[str], *, by: list[str] | None = None,
                descending: bool = False, inclusive: bool = True, out_prefix: str = "cum_",
                bucket: Column | None = None, n_buckets: int | None = None, many_groups: bool = False) -> DataFrame:
    """Add ``<out_prefix><c>`` = sum of ``c`` over rows at or before this row.

    ``order_cols`` must identify a row uniquely within ``by`` (aggregate to
    distinct order values first). ``descending=True`` sums from the other
    end (reverse running sum, e.g. the risk set of a Kaplan-Meier table);
    ``inclusive=False`` leaves the current row out. ``bucket`` may be given
    as an expression non-decreasing in the ascending order of the keys
    (e.g. ``floor(day / 30)``; it is negated for a descending sum);
    otherwise bounds come from a sample of the first order column, inside
    the plan. ``many_groups`` says that the groups of ``by`` grow with the
    input: their offsets are merged by key, never collected for a broadcast.
    """
    by = list(by or [])
    if bucket is None:
        df = df.withColumn("_bounds", bucket_bounds(df, order_cols[0], _n_buckets(df, n_buckets)))
        bucket = F.coalesce(F.size(F.filter("_bounds", lambda x: x < F.col(order_cols[0]))), F.lit(0))
    if descending:
        bucket = -bucket
    okeys = [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]
    b = df.withColumn("_bk", bucket.cast("long")).drop("_bounds")
    w_in = Window.partitionBy(*by, "_bk").orderBy(*okeys)
    frame = w_in.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    for c in sum_cols:
        b = b.withColumn("_loc_" + c, F.coalesce(F.sum(c).over(frame), F.lit(0).cast(df.schema[c].dataType)))
    tot = b.groupBy(*by, "_bk").agg(*[F.sum(c).alias("_tot_" + c) for c in sum_cols])
    w_off = Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*by, "_bk", *[F.coalesce(F.sum("_tot_" + c).over(w_off), F.lit(0)).alias("_off_" + c)
                                   for c in sum_cols])
    out = b.join(off.hint("merge") if many_groups else off, [*by, "_bk"])
    for c in sum_cols:
        out = out.withColumn(out_prefix + c, F.col("_loc_" + c) + F.col("_off_" + c))
    return out.drop("_bk", *["_loc_" + c for c in sum_cols], *["_off_" + c for c in sum_cols])


def global_row_number(df: DataFrame, order_cols: list[str], *, out: str = "rn", descending: bool = False,
                      bucket: Column | None = None, n_buckets: int | None = None) -> DataFrame:
    """1-based position of each row in the global order (no single-task window)."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    res = running_sum(one, order_cols, ["_one"], descending=descending, out_prefix="_cum",
                      bucket=bucket, n_buckets=n_buckets)
    return res.withColumnRenamed("_cum_one", out).drop("_one")


def dense_index(df: DataFrame, col: str, *, out: str = "index", base: int = 0,
                n_buckets: int | None = None) -> DataFrame:
    """Map each distinct value of ``col`` to its position in sorted order."""
    vals = df.select(col).filter(F.col(col).isNotNull()).distinct()
    idx = global_row_number(vals, [col], out="_rn", n_buckets=n_buckets)
    return idx.select(col, (F.col("_rn") - 1 + base).alias(out))

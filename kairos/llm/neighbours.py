"""The next row in id order, without moving all rows into one task.

Rows get a bucket by bounds taken from the ids themselves; a window inside each
bucket finds the next row. A bound is the least id of its bucket: its rows also
go to the end of the bucket before, so that its last row finds them. The rows
of the least id also end the last bucket: after the last row comes the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairos.operators.running import _n_buckets, bucket_bounds

_LEAST = -(1 << 63)


def with_next(df: DataFrame, key: str, tie: str, columns: dict[str, Column]) -> DataFrame:
    """``df`` with each of ``columns`` (name: expression over a row) taken from the next row.

    Rows are ordered by ``key`` (a long; nulls first), then ``tie``; rows of one
    key stay together. A table of one row has itself as the next.
    """
    own = df.withColumn("_at", F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)))
    ids = own.select("_at")
    own = own.withColumn("_bounds", bucket_bounds(ids, "_at", _n_buckets(df, None))).withColumn("_first", ids.agg(F.min("_at")).scalar()).withColumn(
        "_bucket", F.size(F.filter("_bounds", lambda b: b <= F.col("_at"))))
    place = lambda bucket, extra: F.struct(bucket.cast("int").alias("bucket"), F.lit(extra).alias("extra"))
    places = F.filter(F.array(
        place(F.col("_bucket"), 0), F.when(F.array_contains("_bounds", F.col("_at")), place(F.col("_bucket") - 1, 1)),
        F.when(F.col("_at") == F.col("_first"), place(F.size("_bounds"), 2))), lambda x: x.isNotNull())
    spread = own.withColumn("_place", F.explode(places)).drop("_bounds", "_bucket", "_first")
    order = Window.partitionBy("_place.bucket").orderBy("_place.extra", "_at", tie)
    found = spread.select("*", *[F.lead(expr).over(order).alias(name) for name, expr in columns.items()])
    return found.filter(F.col("_place.extra") == 0).select(*df.columns, *columns)

"""Sinks (A2, A7, A8) and the shared scratch location.

Intermediate tables go under the shared folder the cluster names in
``spark.checkpoint.dir`` (never a machine-local temporary folder); writes
are whole-directory overwrites, so a retried job leaves one complete copy.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairos.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a table under the session's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/kairos-tables/{name}-{uuid.uuid4().hex[:12]}"


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables this session has written under its checkpoint folder; for callers that are done with them."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/kairos-tables")
    path.getFileSystem(conf).delete(path, True)


def write_parquet(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Parquet (array columns kept), optionally partitioned by columns."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, *, header: bool = True, mode: str = "overwrite",
              single_file: bool = False) -> str:
    """CSV export of a result table. ``single_file`` only for small, bounded reports."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", header).csv(path)
    return path


def write_packed_texts(df: DataFrame, path: str, *, doc: str = "doc", text: str = "text", mode: str = "overwrite") -> str:
    """A5: many texts in few container files, one record each (id, text), read back by ``readers.read_packed_texts``.

    A folder of one file per text is listed by the driver and costs a file
    handle each; here a task writes one file. The record separator inside a
    text is escaped, so texts survive whatever they hold; a null text is a
    record without one. Ids must not hold either separator.
    """
    from kairos.sources.readers import ID_END, RECORD_END
    escaped = F.replace(F.replace(F.col(text), F.lit("\\"), F.lit("\\s")), F.lit(RECORD_END), F.lit("\\e"))
    value = F.concat(F.col(doc).cast("string"), F.coalesce(F.concat(F.lit(ID_END), escaped), F.lit("")))
    df.select(value.alias("value")).write.mode(mode).option("lineSep", RECORD_END).text(path)
    return path


def persist_table(df: DataFrame, name: str, *, partition_by: Sequence[str] = ()) -> DataFrame:
    """A8 + lineage cut: write to the shared folder and read back (for the next stage)."""
    spark = df.sparkSession
    path = write_parquet(df, shared_path(spark, name), partition_by=partition_by)
    return spark.read.parquet(path)


def array_to_text(c: str, sep: str = ",") -> F.Column:
    """Array column as delimited text for CSV sinks (CSV has no array type)."""
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), sep)

"""Readers (A1-A6, A9, A10): explicit schemas at the edge, no inference in production."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: What ends a record of a packed text file, and what ends its id: the control characters made for it.
RECORD_END, ID_END = "\x1e", "\x1f"


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None,
              lower_bound: int | None = None, upper_bound: int | None = None, num_partitions: int = 1,
              properties: Mapping[str, str] | None = None, fetch_size: int = 10_000) -> DataFrame:
    """A1: table scan over JDBC, split into ``num_partitions`` range reads on a
    numeric column (each executor opens its own connection); filters and
    column selections applied afterwards are pushed into the SELECT."""
    opts = dict(properties or {})
    opts["fetchsize"] = str(fetch_size)
    if partition_column is not None:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower_bound, upperBound=upper_bound,
                               numPartitions=num_partitions, properties=opts)
    return spark.read.jdbc(url, table, properties=opts)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A2: parquet; partition folders become columns and are pruned by filters."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *, header: bool = True,
             null_value: str | None = None, date_format: str | None = None) -> DataFrame:
    """A3: delimited text with typed columns; ``null_value`` maps a sentinel (e.g. 'NULL') to null."""
    r = spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE")
    if null_value is not None:
        r = r.option("nullValue", null_value)
    if date_format is not None:
        r = r.option("dateFormat", date_format)
    return r.csv(path)


def read_text_folder(spark: SparkSession, path: str, *, id_pattern: str = r"([^/]+)\.txt$") -> DataFrame:
    """A5: every file of a folder as one row ``(doc, text, ...)``; the id comes from the
    file name; ``key=value`` sub-folders become columns (partition discovery)."""
    d = spark.read.text(path, wholetext=True)
    rest = [c for c in d.columns if c != "value"]
    return d.select(F.regexp_extract(F.input_file_name(), id_pattern, 1).alias("doc"), F.col("value").alias("text"),
                    *rest)


def read_packed_texts(spark: SparkSession, path: str) -> DataFrame:
    """A5 for many texts: rows (doc, text) of the container files of ``writers.write_packed_texts``; splits fall between records."""
    d = spark.read.option("lineSep", RECORD_END).text(path)
    cut = F.instr("value", ID_END)
    text = F.replace(F.replace(F.expr(f"substring(value, instr(value, '{ID_END}') + 1)"), F.lit("\\e"), F.lit(RECORD_END)), F.lit("\\s"), F.lit("\\"))
    return d.select(F.when(cut > 0, F.expr("substring(value, 1, instr(value, '" + ID_END + "') - 1)")).otherwise(F.col("value")).alias("doc"),
                    F.when(cut > 0, text).alias("text"))


def read_extracts(spark: SparkSession, files: Sequence[str], types: Mapping[str, str], *,
                  date_pattern: str = r"(\d{8})", date_format: str = "yyyyMMdd",
                  fill_missing: Mapping[str, int] | None = None) -> DataFrame:
    """Several extract files with differing columns into one table.

    Each file is read with its own header; the extract date comes from the
    file name; columns absent from a file are null after ``unionByName``;
    ``fill_missing={col: days}`` fills such a date column with the extract
    date plus ``days``. The file list is small (one entry per extract).
    """
    parts = []
    for f in files:
        d = spark.read.option("header", True).csv(f)
        d = d.withColumn("file_date", F.to_date(F.regexp_extract(F.input_file_name(), date_pattern, 1), date_format))
        for c, t in types.items():
            if c in d.columns:
                d = d.withColumn(c, F.col(c).try_cast(t))
        parts.append(d)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    for c, t in types.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    for c, days in (fill_missing or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.date_add("file_date", days)))
    return out


def timestamp_like_columns(df: DataFrame, lengths: Sequence[int] = (19, 27)) -> list[str]:
    """A9 detection: string columns whose non-null values all have one of ``lengths``.

    One aggregate over all string columns (min/max length and a count of
    other lengths), not a pass per column.
    """
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strs:
        return []
    ok = F.array(*[F.lit(n) for n in lengths])
    aggs = []
    for c in strs:
        aggs.append(F.count_if(F.col(c).isNotNull() & ~F.array_contains(ok, F.length(c))).alias(f"bad_{c}"))
        aggs.append(F.count(c).alias(f"n_{c}"))
    r = df.agg(*aggs).first()
    return [c for c in strs if r[f"n_{c}"] > 0 and r[f"bad_{c}"] == 0]


def convert_timestamps(df: DataFrame, lengths: Sequence[int] = (19, 27), n_chars: int = 16) -> DataFrame:
    """Convert the detected columns to timestamps cut to ``n_chars`` characters (minutes)."""
    for c in timestamp_like_columns(df, lengths):
        df = df.withColumn(c, F.try_to_timestamp(F.substring(c, 1, n_chars), F.lit("yyyy-MM-dd HH:mm")))
    return df


def load_configured(spark: SparkSession, config: Mapping[str, Mapping[str, bool]], loaders: Mapping[str, object],
                    *, flag: str = "process") -> dict[str, DataFrame]:
    """A10: build the lazy DataFrames of the tables whose ``flag`` is set in the config."""
    return {name: loaders[name]() for name, opts in config.items() if opts.get(flag) and name in loaders}

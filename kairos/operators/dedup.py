"""Dedup, set operations, splits, top-N and dictionary encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairos.operators.running import dense_index


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by an explicit order (S2; ``order`` must break ties).

    A grouped ``min_by`` of the whole row: the aggregate is partial (each
    map task keeps one candidate per key), so a hot key never lands in one
    task with all its rows, unlike a ``row_number`` window.
    """
    key, order = list(key), list(order)
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*key, *[F.col("_row")[c].alias(c) for c in rest])


def first_non_null(df: DataFrame, key: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """D3: per key and column, the first non-null value by ``order`` (pandas ``first``).

    ``min_by`` ignores rows whose ordering value is null, so each column is
    ordered by ``order`` only where the column has a value; a result row may
    mix source rows, as in the reference. Ties on ``order`` break by value.
    """
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c)))).alias(c)
            for c in cols]
    return df.groupBy(*key).agg(*aggs)


def duplicated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys with more than one row, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def first_occurrence(df: DataFrame, key: Sequence[str], time: str, out: str | None = None) -> DataFrame:
    """First time per key."""
    return df.groupBy(*key).agg(F.min(time).alias(out or time))


def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def intersect_keys(key: str, *dfs: DataFrame) -> DataFrame:
    """Keys present in every input (chained semi joins on distinct keys)."""
    out = dfs[0].select(key).distinct()
    for d in dfs[1:]:
        out = out.join(d.select(key), key, "left_semi")
    return out


def difference_keys(key: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of ``a`` missing in ``b``."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


# Fixed values of the integer hash used for patient-level splits: multiply
# and add modulo the Mersenne prime 2^31 - 1, two rounds. Every step stays
# below 2^62, so the same text runs in any SQL engine with 64-bit integers.
HASH_P = 2147483647
HASH_A1, HASH_B1 = 1103515245, 12345
HASH_A2, HASH_B2 = 214013, 2531011


def id_hash(c) -> Column:
    """Deterministic hash of a non-negative integer id, in [0, 2^31-1)."""
    x = F.pmod(F.col(c) if isinstance(c, str) else c, F.lit(HASH_P))
    x = F.pmod(x * F.lit(HASH_A1) + F.lit(HASH_B1), F.lit(HASH_P))
    return F.pmod(x * F.lit(HASH_A2) + F.lit(HASH_B2), F.lit(HASH_P))


def id_hash_sql(c: str) -> str:
    x = f"(({c}) % {HASH_P})"
    x = f"(({x} * {HASH_A1} + {HASH_B1}) % {HASH_P})"
    return f"(({x} * {HASH_A2} + {HASH_B2}) % {HASH_P})"


def split_label(c, test_pct: int = 20, held_out: Column | None = None) -> Column:
    """0 = train, 2 = test by hash bucket; 3 = held out when ``held_out`` is true.

    Train and test never share a patient, for any row order or partitioning.
    """
    lab = F.when(F.pmod(id_hash(c), F.lit(100)) < F.lit(100 - test_pct), F.lit(0)).otherwise(F.lit(2))
    return F.when(held_out, F.lit(3)).otherwise(lab) if held_out is not None else lab


def fold_of(c, k: int = 10) -> Column:
    """Fold 1..k from the same hash."""
    return (F.pmod(id_hash(c), F.lit(k)) + F.lit(1)).cast("int")


def top_n_by_frequency(df: DataFrame, col: str, n: int, by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """The ``n`` most frequent values (per group), ties by value; rows stand for ``count`` occurrences where it is given."""
    cnt = df.groupBy(*by, col).agg((F.count(F.lit(1)) if count is None else F.sum(count)).alias("n"))
    if not by:  # distributed take-ordered, then rank the <= n survivors
        top = cnt.orderBy(F.col("n").desc(), F.col(col).asc()).limit(n)
        w = Window.orderBy(F.col("n").desc(), F.col(col).asc())
        return top.withColumn("rank", F.row_number().over(w))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col(col).asc())
    return cnt.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def keep_large_groups(df: DataFrame, key: Sequence[str], min_rows: int = 100, *, few: bool = False) -> DataFrame:
    """Rows of groups with more than ``min_rows`` rows (groupBy + semi join).

    ``few`` says that the groups are few, however many rows there are (features): ``df`` and they are written
    once, and they are broadcast, so that no row is shuffled to its group.
    """
    if few:
        from kairos.sources.writers import persist_table
        df = persist_table(df, "grouped_rows")
    big = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > min_rows).select(*key)
    return df.join(F.broadcast(persist_table(big, "large_groups")) if few else big, list(key), "left_semi")


def encode(df: DataFrame, col: str, out: str = "index") -> DataFrame:
    """Add the dense index of ``col`` in sorted order (0-based)."""
    return df.join(dense_index(df, col, out=out), col, "left")

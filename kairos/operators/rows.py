"""Row-level operators: projection, filters, recodes, labels, unpivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairos.functions.bins import cut_by_column
from kairos.operators.running import running_sum


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def not_null(df: DataFrame, *cols: str) -> DataFrame:
    """B2: keep rows where every listed column is present."""
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df.filter(cond) if cond is not None else df


def sentinel_to_null(c, sentinel) -> Column:
    """Sentinel value (e.g. the string 'NULL', code 999) -> null."""
    return F.nullif(_c(c), F.lit(sentinel))


def disagreement(df: DataFrame, a: str, b: str, threshold: float = 5, one_sided: bool = False) -> DataFrame:
    """Rows where two scores differ by at least ``threshold`` (``a - b`` if one-sided)."""
    d = _c(a) - _c(b)
    return df.filter(d >= threshold if one_sided else F.abs(d) >= threshold)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name_col: str = "name",
            value_col: str = "value", codes: dict[str, int] | None = None, code_col: str = "code") -> DataFrame:
    """Wide -> long, optionally with a numeric code per source column."""
    long = df.unpivot(list(ids), list(values), name_col, value_col)
    if codes:
        m = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
        long = long.withColumn(code_col, m[F.col(name_col)].cast("long"))
    return long


def quantile_cuts(df: DataFrame, value: str, g: int, by: Sequence[str] = ()) -> DataFrame:
    """Per-group cut points for ``g`` quantile groups.

    Rule: the k-th cut (k = 1..g-1) is the smallest observed value whose
    cumulative count reaches ``k*n/g``; groups are left-closed, so a row
    falls in group ``1 + #(cuts <= x)``; equal cuts merge. The cumulative
    counts come from per-value counts and a distributed running sum; each
    distinct value emits only the k's it is the first to reach.
    """
    by = list(by)
    cnt = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_sum(cnt, [value], ["_n"], by=by)
    tot = cnt.groupBy(*by).agg(F.sum("_n").alias("_tot"))
    cum = attach(cum, tot, by)
    kmax = F.expr(f"least(cum__n * {g} div _tot, {g - 1})")
    kmin = F.expr(f"(cum__n - _n) * {g} div _tot + 1")
    hit = (cum.filter(kmin <= kmax)
           .select(*by, value, F.explode(F.sequence(kmin, kmax)).alias("_k")))
    return hit.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("cuts"))


def attach(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join a per-group table; with no groups, ``small`` is a one-row aggregate and its
    columns are attached as one scalar subquery (computed once, no join)."""
    by = list(by)
    if by:
        return df.join(small, by, "left")
    cols = small.columns
    packed = small.select(F.struct(*cols).alias("_s")).scalar()
    return df.select("*", *[packed[c].alias(c) for c in cols])


def quantile_bin(df: DataFrame, value: str, g: int, by: Sequence[str] = (), out: str = "qbin") -> DataFrame:
    """Assign each row its quantile group within ``by`` (see ``quantile_cuts``)."""
    j = attach(df, quantile_cuts(df, value, g, by), by)
    return j.withColumn(out, F.when(F.col(value).isNotNull(), cut_by_column(value, "cuts"))).drop("cuts")


def quantile_bin_type7(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                       out: str = "qbin") -> DataFrame:
    """B15, numpy/R type-7 variant: cuts = exact type-7 quantiles per group, right-closed bins.

    Bin = ``1 + #(cuts < x)``.
    """
    from kairos.operators.metrics import quantiles
    by = list(by)
    cuts = quantiles(df, value, probs, by).withColumnRenamed("_q", "_cuts")
    j = attach(df, cuts, by)
    b = (F.size(F.filter(F.col("_cuts"), lambda c: c < F.col(value))) + F.lit(1)).cast("int")
    return j.withColumn(out, F.when(F.col(value).isNotNull(), b)).drop("_cuts")

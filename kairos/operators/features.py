"""Feature tables in long form.

A feature row is ``(eval_id, feature, value)``; a missing entry is simply
an absent row, which keeps the table sparse at any width. Standardisation
statistics come from training rows only and reach the rows as a join on
``feature`` (one row per feature, a bounded table).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairos.functions.dates import day_number
from kairos.operators.dedup import union_all
from kairos.operators.rows import attach, unpivot


def event_table(sources: Sequence[tuple[DataFrame, str, str, str]], *, key: str = "patient_id",
                first_only_prefixes: Sequence[str] = ("diag_",)) -> DataFrame:
    """assemble coded events into ``(key, item_date, feature_name, date_int)``.

    ``sources`` are ``(table, date column, name expression SQL, prefix)``.
    The first entry of a comma list is kept (B19); names get the prefix;
    prefixes in ``first_only_prefixes`` keep only the first date per
    (patient, feature) (D5); null dates are dropped; one row per
    (patient, day number, feature) (D2).
    """
    parts = []
    for df, dcol, name_expr, prefix in sources:
        name = F.concat(F.lit(prefix), F.regexp_replace(F.expr(name_expr), ",.*", ""))
        parts.append(df.select(key, F.col(dcol).alias("item_date"), name.alias("feature_name")))
    ev = union_all(*parts).filter(F.col("item_date").isNotNull() & F.col("feature_name").isNotNull())
    if first_only_prefixes:
        is_first = F.lit(False)
        for p in first_only_prefixes:
            is_first = is_first | F.col("feature_name").startswith(p)
        firsts = (ev.filter(is_first).groupBy(key, "feature_name").agg(F.min("item_date").alias("item_date")))
        ev = firsts.unionByName(ev.filter(~is_first))
    ev = ev.withColumn("date_int", day_number("item_date").cast("int"))
    return (ev.groupBy(key, "date_int", "feature_name").agg(F.min("item_date").alias("item_date"))
            .select(key, "item_date", "feature_name", "date_int"))


def labs_vitals(labs: DataFrame, vitals: DataFrame, codes: dict[str, int], *, key: str = "patient_id",
                lab_time: str = "result_date", vital_time: str = "contact_date",
                selected: Sequence[int] | None = None) -> DataFrame:
    """vitals unpivoted to component codes, union with labs, day-floored, distinct."""
    present = [c for c in codes if c in vitals.columns]
    v = unpivot(vitals.select(key, vital_time, *[F.col(c).cast("double").alias(c) for c in present]),
                [key, vital_time], present, "component_name", "value", {c: codes[c] for c in present},
                "component_id")
    v = v.select(key, "component_id", F.col(vital_time).alias("result_date"), "value")
    lab = labs.select(key, F.col("component_id").cast("long"), F.col(lab_time).alias("result_date"),
                      F.col("value").cast("double"))
    out = lab.unionByName(v)
    if selected is not None:
        out = out.filter(F.col("component_id").isin(list(selected)))
    out = out.withColumn("result_date", F.to_date("result_date"))
    return out.distinct()


def train_stats(df: DataFrame, *, feature: str, value: str, train: str | None = None,
                sample: bool = True) -> DataFrame:
    """F8/F11 statistics per feature on training rows: mean and std (sample or population, S10)."""
    d = df.filter(F.col(train)) if train else df
    sd = F.stddev_samp(value) if sample else F.stddev_pop(value)
    return d.groupBy(feature).agg(F.avg(value).alias("mean"), sd.alias("std"),
                                  F.count(value).alias("n"))


def standardize(df: DataFrame, stats: DataFrame, *, feature: str, value: str, out: str | None = None,
                drop_constant: bool = True) -> DataFrame:
    """(value - mean) / std with the given statistics; constant features dropped."""
    j = df.join(stats.select(feature, "mean", "std"), feature)
    if drop_constant:
        j = j.filter(F.col("std").isNotNull() & (F.col("std") != 0))
    return j.withColumn(out or value, (F.col(value) - F.col("mean")) / F.col("std")).drop("mean", "std")


def demographics(evals: DataFrame, people: DataFrame, *, key: str = "patient_id", eval_id: str = "visit_id",
                 eval_time: str = "visit_date", dob: str = "dob", sex: str = "sex") -> DataFrame:
    """age at evaluation (days/365) and a female flag, as long rows."""
    j = evals.select(key, eval_id, eval_time).join(people.select(key, dob, sex), key)
    age = F.datediff(F.col(eval_time), F.col(dob)) / F.lit(365.0)
    female = F.when(F.col(sex) == "Female", F.lit(1.0)).otherwise(F.lit(0.0))
    return j.select(eval_id, F.explode(F.array(
        F.struct(F.lit("age").alias("feature"), age.alias("value")),
        F.struct(F.lit("female").alias("feature"), female.alias("value")))).alias("_f")).select(
        eval_id, "_f.feature", "_f.value")


def assemble(sources: Sequence[tuple[DataFrame, str, str, str]], *, eval_id: str = "visit_id") -> DataFrame:
    """union of long sources ``(df, feature column, value column, category)``
    into ``(eval_id, feature, category, value)``; feature names are prefixed
    by category so they stay unique across sources."""
    parts = [df.select(eval_id, F.concat(F.lit(cat + ":"), F.col(fcol).cast("string")).alias("feature"),
                       F.lit(cat).alias("category"), F.col(vcol).cast("double").alias("value"))
             for df, fcol, vcol, cat in sources]
    return union_all(*parts)


def feature_dictionary(long: DataFrame) -> DataFrame:
    """F10 dictionary: feature, category, rows present, dense index in sorted order.

    The counts (one row per feature) are written once; the index reads them.
    """
    from kairos.operators.running import dense_index
    from kairos.sources.writers import persist_table
    d = persist_table(long.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n_present")), "feature_counts")
    return d.join(dense_index(d, "feature"), "feature")


def feature_statistics(long: DataFrame, evals: DataFrame, *, eval_id: str = "visit_id", train: str = "is_train",
                       zero_filled: Sequence[str] = ()) -> DataFrame:
    """F11 statistics per feature, in one pass over the long rows: n, mean and std on training rows, include
    and fill_z (see ``impute_standardize``), and n_all and sum_z, the count and the standardised sum of all
    present rows. Features without a training row are left out."""
    ev = evals.select(eval_id, train)
    n_train = ev.filter(F.col(train)).agg(F.count(F.lit(1)).alias("_ntr"))
    zf = F.col("category").isin(list(zero_filled)) if zero_filled else F.lit(False)
    tr = F.when(F.col(train), F.col("value"))
    agg = (long.join(ev, eval_id).groupBy("feature", "category")
           .agg(F.count(tr).alias("n"), F.sum(tr).alias("_s"), F.sum(tr ** 2).alias("_ss"), F.stddev_pop(tr).alias("_sdp"),
                F.avg(tr).alias("_m"), F.count_if(F.col(train)).alias("_rows"), F.count("value").alias("n_all"),
                F.sum("value").alias("_sall")))
    agg = attach(agg.filter("_rows > 0"), n_train, [])
    mean_zf = F.col("_s") / F.col("_ntr")
    std_zf = F.sqrt(F.greatest(F.col("_ss") / F.col("_ntr") - mean_zf * mean_zf, F.lit(0.0)))
    stats = agg.select(
        "feature", "category", "n", "n_all", "_sall",
        F.when(zf, mean_zf).otherwise(F.col("_m")).alias("mean"),
        F.when(zf, std_zf).otherwise(F.col("_sdp")).alias("std"))
    stats = stats.withColumn("include", F.col("std").isNotNull() & (F.col("std") > 1e-12))
    stats = stats.withColumn("fill_z", F.when(zf & F.col("include"), -F.col("mean") / F.col("std")).otherwise(F.lit(0.0)))
    return stats.withColumn("sum_z", F.when(F.col("include"), (F.col("_sall") - F.col("n_all") * F.col("mean")) / F.col("std"))).drop("_sall")


def impute_standardize(long: DataFrame, evals: DataFrame, *, eval_id: str = "visit_id",
                       train: str = "is_train", zero_filled: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """mean imputation, standardisation, zero-variance drop, NaN -> 0.

    For ordinary categories an absent row is a missing value: statistics are
    over training evaluations where the feature is present (numpy
    ``nanmean``/``nanstd``, population std), an imputed entry equals the mean
    and standardises to 0, so it stays an absent row. Categories listed in
    ``zero_filled`` (event weights) mean 0 when absent: their mean and
    variance run over all training evaluations, and the standardised value
    of an absent entry is returned once per feature as ``fill_z`` instead of
    being written for every evaluation, which keeps the table sparse.
    Returns ``(standardised present rows, statistics)``.
    """
    stats = feature_statistics(long, evals, eval_id=eval_id, train=train, zero_filled=zero_filled)
    z = long.join(stats.filter("include").select("feature", "mean", "std"), "feature")
    z = z.select(eval_id, "feature", ((F.col("value") - F.col("mean")) / F.col("std")).alias("z"))
    return z, stats

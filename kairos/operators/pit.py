"""Point-in-time joins and time-decayed features.

Every evaluation row ``(key, eval_id, eval_time)`` is matched with the events
of the same key that were known at ``eval_time``. Three physical shapes:

* **bucketed range join** (bounded look-back): events get a time bucket
  ``floor(day / width)`` with ``width >= look-back``; an evaluation row is
  replicated into the buckets that can hold a match, and the join is an
  equi join on ``(key, bucket)`` plus the range predicate. The pairs a task
  sees are limited to two buckets of one key, and one key with a very long
  history is split over many tasks instead of one. No side is repartitioned by
  hand, so AQE's skew join can split a hot ``(key, bucket)`` at run time; an
  optional ``salt`` does so ahead of it.
* **bucketed running sums** (unbounded look-back, F2): since the decay weight is
  normalised, ``2^(-eval/h)`` cancels and the decayed mean equals
  ``sum(2^(t/h) v) / sum(2^(t/h))`` over all events up to ``eval``. Weights are
  taken inside time buckets and re-scaled from bucket to bucket, so no date is
  out of range. Linear in the input, no pair explosion.
* **first-occurrence join** (F4's widest tier): "any event at or before the
  evaluation" only needs the first event per ``(key, feature)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType
from pyspark.sql.window import Window

from kairos.functions.dates import DAY_MICROS


def _is_date(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, DateType)


def day_value(df: DataFrame, c: str) -> Column:
    """Days since 1970-01-01 as a double (fractional for timestamps)."""
    if _is_date(df, c):
        return F.unix_date(F.col(c)).cast("double")
    return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(DAY_MICROS)


def range_join(evals: DataFrame, events: DataFrame, *, key: str, eval_time: str, event_time: str,
               lookback_days: float | None, max_gap_inclusive: bool = False,
               bucket_days: float | None = None, salt: int = 1, truncate_days: bool = False) -> DataFrame:
    """Point-in-time join (C5): pairs with ``0 <= gap`` and ``gap < lookback``.

    Output columns: all eval columns, all event columns except ``key``, and
    ``gap_days`` (eval day - event day). ``max_gap_inclusive`` turns the upper
    bound into ``gap <= lookback`` (the step-tier rules use ``<=``);
    ``truncate_days`` takes whole-day numbers first (integer date numbers).
    Unbounded look-back (``None``) joins on the key only.
    """
    ev_day = day_value(events, event_time)
    v_day = day_value(evals, eval_time)
    if truncate_days:
        ev_day, v_day = F.floor(ev_day).cast("double"), F.floor(v_day).cast("double")
    e = events.withColumn("_eday", ev_day)
    v = evals.withColumn("_vday", v_day)
    cond_keys = [key]
    if lookback_days is not None:
        width = float(bucket_days or lookback_days)
        # one extra bucket when the bound is inclusive and width == look-back
        span = int(-(-float(lookback_days) // width)) + (1 if max_gap_inclusive else 0)
        e = e.withColumn("_b", F.floor(F.col("_eday") / F.lit(width)))
        v = v.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_vday") / F.lit(width)) - F.lit(span),
                                                     F.floor(F.col("_vday") / F.lit(width)))))
        cond_keys.append("_b")
    if salt > 1:
        e = e.withColumn("_s", F.pmod(F.xxhash64(*[F.col(c) for c in events.columns]), F.lit(salt)))
        v = v.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)).cast("array<bigint>")))
        cond_keys.append("_s")
    e = e.withColumnRenamed(key, "_k")
    cond = [F.col(k) == F.col("_k" if k == key else "_e" + k) for k in cond_keys]
    for k in cond_keys[1:]:
        e = e.withColumnRenamed(k, "_e" + k)
    gap = F.col("_vday") - F.col("_eday")
    cond.append(gap >= 0)
    if lookback_days is not None:
        hi = F.lit(float(lookback_days))
        cond.append(gap <= hi if max_gap_inclusive else gap < hi)
    j = v.join(e, cond, "inner")
    drop = ["_k", "_vday", "_eday", *cond_keys[1:], *["_e" + k for k in cond_keys[1:]]]
    return j.withColumn("gap_days", gap).drop(*drop)


def decayed_mean(evals: DataFrame, events: DataFrame, *, key: str = "patient_id", eval_id: str = "visit_id",
                 eval_time: str = "visit_date", event_time: str = "result_date", feature: str = "component_id",
                 value: str = "value", half_life_days: float = 30.0, lookback_days: float = 365.0,
                 salt: int = 1) -> DataFrame:
    """per (evaluation, feature) mean of ``value`` weighted by ``2^(-gap/h)``.

    Window ``(eval - lookback, eval]``. Null values are dropped before the
    join, so they carry no weight (the reference turned the whole mean NaN).
    No event in the window -> no output row (null after a pivot).
    """
    ev = events.filter(F.col(value).isNotNull()).select(key, feature, event_time, value)
    ev_ = evals.select(key, eval_id, eval_time)
    j = range_join(ev_, ev, key=key, eval_time=eval_time, event_time=event_time,
                   lookback_days=lookback_days, salt=salt)
    w = F.pow(F.lit(2.0), -F.col("gap_days") / F.lit(float(half_life_days)))
    return (j.groupBy(eval_id, feature)
            .agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value)))


#: F2: half-lives that a time bucket spans; 2^256 and sums of it stay far inside a double.
BUCKET_HALF_LIVES = 256


def decayed_mean_unbounded(evals: DataFrame, events: DataFrame, *, key: str = "patient_id",
                           eval_id: str = "visit_id", eval_time: str = "visit_date",
                           event_time: str = "result_date", feature: str = "component_id", value: str = "value",
                           half_life_days: float = 30.0, bucket_days: float | None = None) -> DataFrame:
    """F2 shape: decayed mean over **all** earlier events, via running sums.

    Events get a time bucket; inside it the weight is ``2^((t - start)/h)``, at
    most ``2^(width/h)``. Per (key, feature) the bucket totals are folded in
    time order, each re-scaled to the start of the next
    (``sum * 2^(-gap/h)``). An evaluation adds the running sum inside its own
    bucket and the fold of the last bucket before it; where its own bucket has
    no earlier event, the ratio of the fold alone is the answer, however long
    ago the last event lies. Evaluations meet a feature only from its first
    event on.

    The running sum is keyed by (key, feature, bucket), so a long series is
    spread over many tasks; the fold sees one row per bucket of a series.
    """
    h = float(half_life_days)
    width = float(bucket_days or BUCKET_HALF_LIVES * h)
    ev = events.filter(F.col(value).isNotNull())
    ev = ev.select(key, feature, day_value(ev, event_time).alias("_t"), F.col(value).cast("double").alias("_v"))
    ev = ev.withColumn("_b", F.floor(F.col("_t") / F.lit(width)))
    w = F.pow(F.lit(2.0), (F.col("_t") - F.col("_b") * F.lit(width)) / F.lit(h))
    ev = (ev.groupBy(key, feature, "_b", "_t")
          .agg(F.sum(w).alias("_sw"), F.sum(w * F.col("_v")).alias("_swv")))
    total = ev.groupBy(key, feature, "_b").agg(F.sum("_sw").alias("w"), F.sum("_swv").alias("v"), F.min("_t").alias("_t"))

    def step(acc, x):
        last = F.element_at(acc, -1)
        back = F.when(F.size(acc) > 0, F.pow(F.lit(2.0), (last["b"] - x["b"]) * F.lit(width / h))).otherwise(F.lit(0.0))
        return F.concat(acc, F.array(F.struct(
            x["b"].alias("b"), (x["w"] + F.when(F.size(acc) > 0, last["w"] * back).otherwise(F.lit(0.0))).alias("w"),
            (x["v"] + F.when(F.size(acc) > 0, last["v"] * back).otherwise(F.lit(0.0))).alias("v"))))

    none = F.expr("cast(array() as array<struct<b:bigint,w:double,v:double>>)")
    folds = total.groupBy(key, feature).agg(
        F.min("_t").alias("_first"),
        F.aggregate(F.sort_array(F.collect_list(F.struct(F.col("_b").alias("b"), "w", "v"))), none, step).alias("_folds"))
    v = evals.select(key, eval_id, day_value(evals, eval_time).alias("_t")).withColumn("_b", F.floor(F.col("_t") / F.lit(width)))
    v = v.join(folds, key).filter(F.col("_t") >= F.col("_first"))
    fold = F.element_at(F.filter("_folds", lambda x: x["b"] < F.col("_b")), -1)
    v = v.select(key, feature, "_b", "_t", eval_id, F.when(F.size(F.filter("_folds", lambda x: x["b"] < F.col("_b"))) > 0, fold).alias("_before"))
    rows = ev.select(key, feature, "_b", "_t", F.lit(0).alias("_ord"), "_sw", "_swv").unionByName(
        v.select(key, feature, "_b", "_t", F.lit(1).alias("_ord"), eval_id, "_before"), allowMissingColumns=True)
    run = Window.partitionBy(key, feature, "_b").orderBy("_t", "_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_in_w", F.sum("_sw").over(run)).withColumn("_in_v", F.sum("_swv").over(run)).filter(F.col("_ord") == 1)
    before = F.pow(F.lit(2.0), (F.col("_before.b") - F.col("_b")) * F.lit(width / h))
    both_w = F.col("_in_w") + F.coalesce(F.col("_before.w") * before, F.lit(0.0))
    both_v = F.col("_in_v") + F.coalesce(F.col("_before.v") * before, F.lit(0.0))
    mean = F.when(F.col("_in_w").isNotNull(), both_v / both_w).otherwise(F.col("_before.v") / F.col("_before.w"))
    return rows.select(eval_id, feature, mean.alias(value))


# Step tiers of the event-presence weight (days, weight),
# narrowest first; an event at any earlier time gets the last weight.
STEP_TIERS = ((30, 1.0), (60, 0.5), (120, 0.25))
STEP_ANY_WEIGHT = 0.125


def step_weight(gap: Column, tiers=STEP_TIERS, any_weight: float | None = STEP_ANY_WEIGHT) -> Column:
    expr = None
    for days, wt in tiers:
        expr = (F.when(gap <= days, F.lit(wt)) if expr is None else expr.when(gap <= days, F.lit(wt)))
    return expr.otherwise(F.lit(any_weight) if any_weight is not None else F.lit(None).cast("double"))


def step_weighted_presence(evals: DataFrame, events: DataFrame, *, key: str = "patient_id",
                           eval_id: str = "visit_id", eval_time: str = "visit_date", event_time: str = "item_date",
                           feature: str = "feature_name", tiers=STEP_TIERS,
                           any_weight: float | None = STEP_ANY_WEIGHT, salt: int = 1) -> DataFrame:
    """weight of the smallest non-negative gap to an event of each feature.

    Gaps are whole-day numbers (truncated day counts, as the reference's
    ``date_int``). ``any_weight=None`` drops the unbounded tier (F5 shape).
    The near tiers come from a bounded range join; the unbounded tier only
    needs the first event per (key, feature), so no pair explosion occurs.
    """
    ev = events.filter(F.col(event_time).isNotNull()).select(key, feature, event_time)
    ev_ = evals.select(key, eval_id, eval_time)
    widest = max(d for d, _ in tiers)
    near = (range_join(ev_, ev, key=key, eval_time=eval_time, event_time=event_time,
                       lookback_days=float(widest), max_gap_inclusive=True, truncate_days=True, salt=salt)
            .groupBy(eval_id, feature).agg(F.min("gap_days").alias("_g")))
    if any_weight is None:
        return near.select(eval_id, feature, step_weight(F.col("_g"), tiers, None).alias("weight"))
    first = ev.groupBy(key, feature).agg(F.min(F.floor(day_value(ev, event_time))).alias("_f"))
    vd = ev_.withColumn("_vd", F.floor(day_value(ev_, eval_time)))
    anyrow = (vd.join(first, key).filter(F.col("_f") <= F.col("_vd")).select(eval_id, feature))
    out = anyrow.join(near, [eval_id, feature], "left")
    return out.select(eval_id, feature, step_weight(F.col("_g"), tiers, any_weight).alias("weight"))


def presence_within(evals: DataFrame, events: DataFrame, *, days: int = 182, **kw) -> DataFrame:
    """indicator 1.0 when an event of the feature lies 0..``days`` days before."""
    return step_weighted_presence(evals, events, tiers=((days, 1.0),), any_weight=None, **kw)


def decayed_term_mean(evals: DataFrame, notes: DataFrame, note_terms: DataFrame, *, key: str = "patient_id",
                      eval_id: str = "visit_id", eval_time: str = "visit_date", note_id: str = "note_id",
                      note_time: str = "update_date", term: str = "term", value: str = "value",
                      half_life_days: float = 30.0, lookback_days: float | None = 365.0) -> DataFrame:
    """decayed mean of note term vectors per evaluation.

    The denominator is the weight of **all** notes in the window, also those
    without the term: ``sum(w * value)`` per (evaluation, term) in one pass,
    and the total weight per evaluation (one row each) joined at the end.
    """
    nv = notes.select(key, note_id, note_time)
    j = range_join(evals.select(key, eval_id, eval_time), nv, key=key, eval_time=eval_time,
                   event_time=note_time, lookback_days=lookback_days)
    w = F.pow(F.lit(2.0), -F.col("gap_days") / F.lit(float(half_life_days)))
    j = j.select(eval_id, note_id, w.alias("_w"))
    tot = j.groupBy(eval_id).agg(F.sum("_w").alias("_tw"))
    sums = (j.join(note_terms.select(note_id, term, value), note_id)
            .groupBy(eval_id, term).agg(F.sum(F.col("_w") * F.col(value)).alias("_s")))
    return sums.join(tot, eval_id).select(eval_id, term, (F.col("_s") / F.col("_tw")).alias(value))

"""Cohort, time zero and landmark building."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairos.functions.dates import DAY_MICROS, day_gap
from kairos.operators.dedup import first_occurrence, intersect_keys
from kairos.operators.joins import landmark_rows
from kairos.operators.pit import day_value

# Landmark grid of the training pipeline (every half year up
# to five years) and the administrative censoring horizon, in days.
LANDMARK_STEP = 365.0 / 2
LANDMARKS = tuple(i * LANDMARK_STEP for i in range(11))
HORIZON = 365.0 * 5


def eligible(patients: DataFrame, *, system_start: str, evidence: Sequence[tuple[DataFrame, str]],
             key: str = "patient_id", mets: str = "earliest_mets", lfu: str = "lfu_date",
             death: str = "death_date") -> DataFrame:
    """Last follow-up known, after the system start and after diagnosis; the
    patient has a record on or after diagnosis in every ``evidence`` table
    (``(table, date column)``). Last follow-up is capped at death (B11).
    """
    p = (patients.filter(F.col(lfu).isNotNull() & (F.col(lfu) > F.lit(system_start).cast("date"))
                         & (F.col(lfu) > F.col(mets)))
         .withColumn(lfu, F.when(F.col(death).isNotNull() & (F.col(lfu) > F.col(death)), F.col(death))
                     .otherwise(F.col(lfu))))
    pm = p.select(key, mets)
    sets = [t.select(key, dcol).join(pm, key).filter(F.col(dcol) >= F.col(mets)).select(key)
            for t, dcol in evidence]
    keep = intersect_keys(key, *sets)
    return p.join(keep, key, "left_semi")


def clean_records(records: DataFrame, patients: DataFrame, *, key: str = "patient_id",
                  contact: str = "contact_date", update: str = "update_date", mets: str = "earliest_mets",
                  lfu: str = "lfu_date", death: str = "death_date", dead: str = "dead") -> DataFrame:
    """Records before death, not earlier than diagnosis - 365 d, updated on or after
    contact, at least one day of follow-up left; adds the 12-month labels (B17, S8)."""
    j = records.join(patients.select(key, mets, lfu, death, dead), key)
    before_death = ~F.col(dead) | (F.col(contact) < F.col(death))
    upd_before_death = ~F.col(dead) | (F.col(update) < F.col(death))
    j = j.filter(before_death & upd_before_death
                 & (F.col(contact) >= F.date_sub(F.col(mets), 365))
                 & (F.col(update) >= F.col(contact)))
    j = j.withColumn("fu_days", day_gap(lfu, update)).filter(F.col("fu_days") >= 1)
    year = F.lit(365.0)
    return (j.withColumn("include_surv_12mo", (F.col(update) >= F.col(mets))
                         & (F.col(dead) | (F.col("fu_days") > year)))
            .withColumn("surv_12mo", ~F.col(dead) | (day_gap(death, update) > year)))


def time_zero(records: DataFrame, patients: DataFrame, *, key: str = "patient_id", time: str = "visit_date",
              mets: str = "earliest_mets", out: str = "t0") -> DataFrame:
    """First record on or after diagnosis, per patient."""
    j = records.select(key, time).join(patients.select(key, mets), key).filter(F.col(time) >= F.col(mets))
    return first_occurrence(j, [key], time, out)


def landmarks(t0: DataFrame, records: DataFrame, patients: DataFrame, *, key: str = "patient_id",
              t0_col: str = "t0", record_time: str = "visit_date", grid: Sequence[float] = LANDMARKS,
              window_days: float = LANDMARK_STEP, lfu: str = "lfu_date", dead: str = "dead",
              dob: str = "dob", min_age: float = 18.0) -> DataFrame:
    """E4 + E6: landmark evaluation dates ``t0 + grid``.

    A landmark is kept when a record lies in ``(eval - window, eval]`` and
    ``eval < lfu``; adults only. Half-day landmarks stay timestamps (S4).
    Output: key, landmark, eval_date (timestamp), dead, fu_days, age, date_int.
    """
    ev = landmark_rows(t0.select(key, t0_col), grid)
    ev = ev.withColumn("eval_date", F.timestamp_micros(
        F.unix_micros(F.col(t0_col).cast("timestamp")) + (F.col("landmark") * F.lit(86400e6)).cast("long")))
    p = patients.select(key, lfu, dead, dob)
    ev = ev.join(p, key).filter(F.col("eval_date") < F.col(lfu).cast("timestamp"))
    # a record meets its patient's time zero and is sent to the landmarks it is close to: no pair of a record and a landmark otherwise
    recs = records.select(key, day_value(records, record_time).alias("_day")).join(t0.select(key, t0_col), key)
    start = F.unix_micros(F.col(t0_col).cast("timestamp"))
    gap = lambda x: (start + (x * F.lit(86400e6)).cast("long")) / F.lit(DAY_MICROS) - F.col("_day")
    near = F.filter(F.array(*[F.lit(float(x)) for x in grid]), lambda x: (gap(x) >= 0) & (gap(x) < F.lit(float(window_days))))
    kept = recs.select(key, F.explode(near).alias("landmark")).distinct()
    out = ev.join(kept, [key, "landmark"], "left_semi")
    out = (out.withColumn("fu_days", day_gap(F.col(lfu), F.col("eval_date")))
           .withColumn("age", day_gap(F.col("eval_date"), F.col(dob)) / F.lit(365.0))
           .filter(F.col("age") >= min_age)
           .withColumn("date_int", day_gap(F.col("eval_date"), F.lit("2000-01-01").cast("timestamp")).cast("int")))
    return out.select(key, "landmark", "eval_date", dead, "fu_days", "age", "date_int")


def landmark_set(visits: DataFrame, *, key: str = "patient_id", visit_id: str = "visit_id",
                 time1: str = "time1", fu: str = "days_to_last", dead: str = "dead",
                 grid: Sequence[float] = tuple(365.0 * i for i in range(6)), horizon: float = HORIZON) -> DataFrame:
    """E5: per landmark, each patient's latest visit at or before it (ties kept, S3),
    with ``fu + time1 > landmark``; residual follow-up ``fu - (landmark - time1)``,
    administrative censoring at ``horizon`` (B12), landmark and landmark^2.

    Visits are expanded over the (literal) grid, the latest qualifying time
    per (patient, landmark) is a grouped max, and the visits at that time
    are kept by an equi join, so tied visits all stay.
    """
    v = landmark_rows(visits, grid).filter((F.col("landmark") - F.col(time1) >= 0)
                                           & (F.col(fu) + F.col(time1) > F.col("landmark")))
    best = v.groupBy(key, "landmark").agg(F.max(time1).alias(time1))
    rows = v.join(best, [key, "landmark", time1])
    resid = F.col(fu) - (F.col("landmark") - F.col(time1))
    return rows.select(
        key, visit_id, "landmark", (F.col("landmark") * F.col("landmark")).alias("landmark_sq"), time1,
        F.least(resid, F.lit(horizon)).alias("fu_time"),
        F.when(resid > F.lit(horizon), F.lit(False)).otherwise(F.col(dead)).alias("dead"))


def shifted_evals(treatments: DataFrame, *, key: str = "patient_id", date: str = "tx_date",
                  shift_days: int = 14) -> DataFrame:
    """Evaluation dates on the treatment date and ``shift_days`` earlier."""
    return treatments.select(key, F.col(date).alias("eval_date"), F.date_sub(F.col(date), shift_days)
                             .alias("eval_date_shifted"))


def code_cohort(events: DataFrame, codes: DataFrame, *, key: str = "patient_id", code: str = "feature_name",
                date: str = "item_date", out: str = "first_date") -> DataFrame:
    """Each patient's first event whose code is on the list (semi join to the code list)."""
    hits = events.join(codes.select(code).distinct(), code, "left_semi")
    return first_occurrence(hits, [key], date, out)

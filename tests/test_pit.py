"""Point-in-time joins and decayed features: edge rows of FIXTURES section 3."""

import datetime as dt
import math

import pytest

from pyspark.sql import functions as F

from kairos.operators import pit

D = dt.date


def _evals(spark, rows):
    return spark.createDataFrame(rows, "patient_id long, visit_id long, visit_date date")


def test_window_edges_and_decay(spark):
    ev = _evals(spark, [(1, 10, D(2020, 12, 31))])
    base = D(2020, 12, 31)
    labs = spark.createDataFrame(
        [(1, 7, base - dt.timedelta(days=g), float(v)) for g, v in [(0, 10), (364, 100), (365, 1000), (366, 1000)]]
        + [(1, 7, base + dt.timedelta(days=1), 5000.0)],
        "patient_id long, component_id long, result_date date, value double")
    out = pit.decayed_mean(ev, labs).collect()
    w0, w364 = 1.0, 2 ** (-364 / 30)
    assert len(out) == 1
    assert math.isclose(out[0]["value"], (10 * w0 + 100 * w364) / (w0 + w364), rel_tol=1e-12)


def test_decay_fixture_value(spark):
    ev = _evals(spark, [(1, 10, D(2021, 3, 1))])
    labs = spark.createDataFrame([(1, 1, D(2021, 3, 1), 10.0), (1, 1, D(2021, 1, 30), 20.0)],
                                 "patient_id long, component_id long, result_date date, value double")
    v = pit.decayed_mean(ev, labs).first()["value"]
    assert math.isclose(v, (10 + 20 / 2) / 1.5, rel_tol=1e-12)  # 13.3333


def test_half_day_landmark(spark):
    ev = spark.createDataFrame([(1, 1, dt.datetime(2021, 3, 1, 12, 0))], "patient_id long, visit_id long, visit_date timestamp")
    labs = spark.createDataFrame([(1, 1, dt.datetime(2021, 3, 1, 0, 0), 4.0), (1, 1, dt.datetime(2021, 2, 1), 8.0)],
                                 "patient_id long, component_id long, result_date timestamp, value double")
    v = pit.decayed_mean(ev, labs).first()["value"]
    w1, w2 = 2 ** (-0.5 / 30), 2 ** (-28.5 / 30)
    assert math.isclose(v, (4 * w1 + 8 * w2) / (w1 + w2), rel_tol=1e-12)


def test_null_value_ignored_and_missing(spark):
    ev = _evals(spark, [(1, 1, D(2021, 1, 1)), (2, 2, D(2021, 1, 1))])
    labs = spark.createDataFrame([(1, 1, D(2021, 1, 1), 3.0), (1, 1, D(2020, 12, 1), None)],
                                 "patient_id long, component_id long, result_date date, value double")
    out = {r["visit_id"]: r["value"] for r in pit.decayed_mean(ev, labs).collect()}
    assert out == {1: 3.0}  # patient 2 has no labs -> no row (null after pivot)


def test_step_tiers(spark):
    base = D(2021, 6, 1)
    gaps = [30, 31, 60, 61, 120, 121]
    ev = _evals(spark, [(i, i, base) for i in range(len(gaps))] + [(99, 99, base)])
    items = spark.createDataFrame([(i, base - dt.timedelta(days=g), "f") for i, g in enumerate(gaps)]
                                  + [(99, base - dt.timedelta(days=200), "f"), (99, base - dt.timedelta(days=10), "f"),
                                     (99, base + dt.timedelta(days=1), "g")],
                                  "patient_id long, item_date date, feature_name string")
    out = {(r["visit_id"], r["feature_name"]): r["weight"] for r in pit.step_weighted_presence(ev, items).collect()}
    assert [out[(i, "f")] for i in range(len(gaps))] == [1.0, 0.5, 0.5, 0.25, 0.25, 0.125]
    assert out[(99, "f")] == 1.0 and (99, "g") not in out  # future event ignored


def test_future_events_do_not_leak(spark):
    ev = _evals(spark, [(1, 1, D(2021, 1, 1)), (1, 2, D(2021, 6, 1))])
    labs = [(1, 1, D(2020, 12, 1), 1.0), (1, 1, D(2021, 5, 1), 2.0)]
    schema = "patient_id long, component_id long, result_date date, value double"
    a = {r["visit_id"]: r["value"] for r in pit.decayed_mean(ev, spark.createDataFrame(labs, schema)).collect()}
    future = labs + [(1, 1, D(2022, 1, 1), 999.0), (1, 1, D(2021, 6, 2), 999.0)]
    b = {r["visit_id"]: r["value"] for r in pit.decayed_mean(ev, spark.createDataFrame(future, schema)).collect()}
    assert a == b


def test_salted_join_equals_plain(spark):
    import random
    random.seed(3)
    ev = _evals(spark, [(p, p * 100 + k, D(2020, 1, 1) + dt.timedelta(days=random.randint(0, 900)))
                        for p in range(5) for k in range(20)])
    labs = spark.createDataFrame([(p, random.randint(0, 3), D(2019, 6, 1) + dt.timedelta(days=random.randint(0, 1400)),
                                   random.random()) for p in range(5) for _ in range(200)],
                                 "patient_id long, component_id long, result_date date, value double")
    a = {(r[0], r[1]): round(r[2], 10) for r in pit.decayed_mean(ev, labs).collect()}
    b = {(r[0], r[1]): round(r[2], 10) for r in pit.decayed_mean(ev, labs, salt=4).collect()}
    assert a == b and len(a) > 50


def test_unbounded_window_form_matches_pairs(spark):
    import random
    random.seed(5)
    ev = _evals(spark, [(p, p * 100 + k, D(2020, 1, 1) + dt.timedelta(days=random.randint(0, 900)))
                        for p in range(4) for k in range(10)])
    lab_rows = [(p, random.randint(0, 2), D(2019, 6, 1) + dt.timedelta(days=random.randint(0, 1400)), random.random())
                for p in range(4) for _ in range(60)]
    labs = spark.createDataFrame(lab_rows, "patient_id long, component_id long, result_date date, value double")
    got = {(r[0], r[1]): r[2] for r in pit.decayed_mean_unbounded(ev, labs).collect()}
    got_b = {(r[0], r[1]): r[2] for r in pit.decayed_mean_unbounded(ev, labs, bucket_days=90).collect()}
    assert got_b.keys() == got.keys() and all(math.isclose(got_b[k], got[k], rel_tol=1e-9) for k in got)
    exp = {}
    for (p, vid, vd) in ev.collect():
        for c in range(3):
            ws = [(2 ** (-(vd - d).days / 30), v) for (pp, cc, d, v) in lab_rows if pp == p and cc == c and d <= vd]
            if ws:
                exp[(vid, c)] = sum(w * v for w, v in ws) / sum(w for w, _ in ws)
    assert got.keys() == exp.keys()
    for k in exp:
        assert math.isclose(got[k], exp[k], rel_tol=1e-9)


def test_range_join_bucket_boundary(spark):
    # events exactly one look-back apart from the evaluation fall outside, one day less inside
    ev = _evals(spark, [(1, 1, D(2021, 1, 1))])
    e = spark.createDataFrame([(1, D(2021, 1, 1) - dt.timedelta(days=g)) for g in (0, 1, 364, 365, 730)],
                              "patient_id long, result_date date")
    j = pit.range_join(ev, e, key="patient_id", eval_time="visit_date", event_time="result_date", lookback_days=365)
    assert sorted(r["gap_days"] for r in j.collect()) == [0.0, 1.0, 364.0]
    j2 = pit.range_join(ev, e, key="patient_id", eval_time="visit_date", event_time="result_date", lookback_days=365,
                        max_gap_inclusive=True, bucket_days=100)
    assert sorted(r["gap_days"] for r in j2.select(F.col("gap_days")).collect()) == [0.0, 1.0, 364.0, 365.0]


def test_hot_patient_third_of_rows(spark):
    """One patient holds a third of all events: bucketing + salting give the exact brute-force answer."""
    import random
    rng = random.Random(21)
    ev_rows = [(p, p * 1000 + k, D(2018, 1, 1) + dt.timedelta(days=rng.randint(0, 1800))) for p in range(6) for k in range(8)]
    lab_rows = [(0, rng.randint(0, 2), D(2017, 6, 1) + dt.timedelta(days=rng.randint(0, 2300)), rng.random())
                for _ in range(300)]
    lab_rows += [(p, rng.randint(0, 2), D(2017, 6, 1) + dt.timedelta(days=rng.randint(0, 2300)), rng.random())
                 for p in range(1, 6) for _ in range(120)]
    ev = _evals(spark, ev_rows)
    labs = spark.createDataFrame(lab_rows, "patient_id long, component_id long, result_date date, value double")
    exp = {}
    for p, vid, vd in ev_rows:
        for c in range(3):
            ws = [(2 ** (-(vd - d).days / 30), v) for (pp, cc, d, v) in lab_rows
                  if pp == p and cc == c and 0 <= (vd - d).days < 365]
            if ws:
                exp[(vid, c)] = sum(w * v for w, v in ws) / sum(w for w, _ in ws)
    for salt in (1, 8):
        got = {(r[0], r[1]): r[2] for r in pit.decayed_mean(ev, labs, salt=salt).collect()}
        assert got.keys() == exp.keys()
        assert all(math.isclose(got[k], exp[k], rel_tol=1e-9) for k in exp)


@pytest.mark.parametrize("h", [1.0, 30.0])
@pytest.mark.parametrize("bucket_days", [None, 20])
def test_unbounded_survives_sentinel_dates(spark, h, bucket_days):
    """A 1900 date, events thousands of half-lives apart, and a visit long after the last event stay finite and right."""
    days = [D(1900, 1, 1), D(2019, 12, 1), D(2020, 1, 1)]
    labs = spark.createDataFrame([(1, 0, days[0], 3.0), (1, 0, days[2], 7.0), (1, 1, days[0], 5.0), (1, 2, days[1], 1.0), (1, 2, days[2], 2.0)],
                                 "patient_id long, component_id long, result_date date, value double")
    ev = _evals(spark, [(1, 1, D(2020, 2, 1)), (1, 2, D(1950, 1, 1)), (1, 3, D(1899, 1, 1)), (1, 4, days[2])])
    got = {(r[0], r[1]): r[2] for r in pit.decayed_mean_unbounded(ev, labs, half_life_days=h, bucket_days=bucket_days).collect()}
    w = 2.0 ** (-31 / h)
    both = (w * 1.0 + 2.0) / (w + 1.0)
    want = {(1, 0): 7.0, (1, 1): 5.0, (1, 2): both, (2, 0): 3.0, (2, 1): 5.0, (4, 0): 7.0, (4, 1): 5.0, (4, 2): both}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_range_join_lets_spark_split_a_hot_key(spark):
    """Two thirds of all events are one patient's: the executed plan of the range join is a skew join."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8",
            "spark.sql.files.maxPartitionBytes": "64k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 60_000
        p = F.when(F.col("id") % 3 == 0, F.col("id") % 500).otherwise(F.lit(7))
        e = spark.range(0, n, 1, 16).select(p.alias("patient_id"), F.lit(D(2020, 3, 1)).alias("result_date"), F.xxhash64("id").alias("x"),
                                            F.sha2(F.col("id").cast("string"), 512).alias("pad"))
        ev = spark.range(500).select(F.col("id").alias("patient_id"), F.col("id").alias("visit_id"), F.lit(D(2020, 4, 1)).alias("visit_date"))
        j = pit.range_join(ev, e, key="patient_id", eval_time="visit_date", event_time="result_date", lookback_days=365)
        rows = j.collect()
        assert len(rows) == n
        assert "skew=true" in j._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

"""AUC, DeLong, clustered AUC, ROC and threshold metrics against hand cases / brute force."""

import math

import numpy as np
import pytest
import random

from pyspark.sql import functions as F

from kairos.operators import metrics as mt


def test_auc_fixture(spark):
    d = spark.createDataFrame([(1.0, 1), (2.0, 1), (2.0, 0), (3.0, 0)], "s double, y int")
    a = mt.auc(d, score="s", label="y").first()
    assert a["auc"] == 0.125


def _brute(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]

    def psi(a, b):
        return 1.0 if a > b else (0.5 if a == b else 0.0)

    A = sum(psi(p, n) for p in pos for n in neg) / (len(pos) * len(neg))
    v10 = [sum(psi(p, n) for n in neg) / len(neg) for p in pos]
    v01 = [sum(psi(p, n) for p in pos) / len(pos) for n in neg]
    s10 = sum((x - A) ** 2 for x in v10) / (len(pos) - 1)
    s01 = sum((x - A) ** 2 for x in v01) / (len(neg) - 1)
    return A, s10 / len(pos) + s01 / len(neg), v10, v01


def test_auc_delong_brute(spark):
    rng = random.Random(2)
    rows = [(float(rng.randint(0, 20)), int(rng.random() < 0.4)) for _ in range(200)]
    a = mt.auc(spark.createDataFrame(rows, "s double, y int"), score="s", label="y").first()
    A, var, _, _ = _brute(rows)
    assert math.isclose(a["auc"], A, rel_tol=1e-12) and math.isclose(a["var"], var, rel_tol=1e-9)


def test_clustered_auc_one_row_per_cluster_is_delong(spark):
    rng = random.Random(7)
    rows = [(i, float(rng.randint(0, 30)), int(rng.random() < 0.5)) for i in range(120)]
    d = spark.createDataFrame(rows, "c long, s double, y int")
    got = {(r["a"], r["b"]): r for r in mt.clustered_auc(d, scores=["s"], label="y", cluster="c").collect()}
    A, var, v10, v01 = _brute([(s, y) for _, s, y in rows])
    r = got[("s", "s")]
    assert math.isclose(r["auc_a"], A, rel_tol=1e-12)
    # with one subject per cluster the clustered variance reduces to DeLong's, except the S11 term,
    # which vanishes because no cluster holds both a positive and a negative
    assert math.isclose(r["cov"], var, rel_tol=1e-9)


def test_roc_points(spark):
    d = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 0), (4.0, 1)], "s double, y int")
    pts = {r["threshold"]: (r["tpr"], r["fpr"]) for r in mt.roc_points(d, score="s", label="y").collect()}
    assert pts == {1.0: (1.0, 1.0), 2.0: (1.0, 0.5), 3.0: (0.5, 0.5), 4.0: (0.5, 0.0)}


def test_threshold_metrics(spark):
    d = spark.createDataFrame([(True, True)] * 3 + [(True, False)] + [(False, True)] + [(False, False)] * 5,
                              "f boolean, o boolean")
    t = mt.threshold_metrics(d, flag=F.col("f"), outcome=F.col("o")).first()
    assert (t["tp"], t["fp"], t["fn"], t["tn"]) == (3, 1, 1, 5)
    assert math.isclose(t["ppv"], 0.75) and math.isclose(t["npv"], 5 / 6)
    assert math.isclose(t["sensitivity"], 0.75) and math.isclose(t["specificity"], 5 / 6)
    assert math.isclose(t["dor"], 15.0)


@pytest.mark.parametrize("scores, k, threshold, flagged", [
    ([5.0, 4.0, 4.0, 3.0, 1.0], 2, 4.0, 1),       # the cut falls into a tie: fewer than k
    ([5.0, 4.0, 3.5, 3.0, 1.0], 2, 3.5, 2),       # without ties exactly k
    ([5.0, 4.0, 3.0], 0, 5.0, 0), ([5.0, 4.0, 3.0], 3, None, 3), ([2.0, 2.0], 1, 2.0, 0),
])
def test_matched_threshold(spark, scores, k, threshold, flagged):
    d = spark.createDataFrame([(x,) for x in scores], "s double")
    got = mt.matched_threshold(d, score="s", k=spark.range(1).select(F.lit(k).cast("long"))).first()
    assert (got["k"], got["threshold"], got["n_flagged"]) == (k, threshold, flagged)


def test_crosstab_zero_cells_and_chi2(spark):
    d = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", "x")], "r string, c string")
    ct = {(x["r"], x["c"]): x["n"] for x in mt.crosstab(d, "r", "c").collect()}
    assert ct == {("a", "x"): 2, ("a", "y"): 0, ("b", "x"): 1, ("b", "y"): 1}
    chi = mt.chi_square(d, "r", "c").first()
    exp = {("a", "x"): 1.5, ("a", "y"): 0.5, ("b", "x"): 1.5, ("b", "y"): 0.5}
    stat = sum((ct[k] - e) ** 2 / e for k, e in exp.items())
    assert math.isclose(chi["chisq"], stat) and chi["df"] == 1


def test_summary_type7(spark):
    d = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    s = mt.summary(d, "v").first()
    assert (s["min"], s["q1"], s["median"], s["q3"], s["max"]) == (1.0, 1.75, 2.5, 3.25, 4.0)


def test_many_aucs_from_packed_pieces(spark, monkeypatch):
    """F1, F2: the AUCs of an array of scores, merged by bucket, are those of rows of one score each, with ties, nulls and many buckets."""
    rng = random.Random(8)
    rows = [([rng.gauss(0, 1), float(rng.randint(0, 3)), 0.5, rng.choice([None, 1.0, 2.0, -0.0, 0.0])], rng.choice([0, 1, 1, None])) for _ in range(700)]
    df = spark.createDataFrame([*rows, (None, 1)], "scores array<double>, label int").repartition(3)
    each = df.select("label", F.posexplode("scores").alias("index", "score"))
    want = {r["index"]: r for r in mt.auc(each, score="score", label="label", by=["index"]).collect()}
    monkeypatch.setattr(mt, "PIECE_ROWS", 100)
    sample = np.array([[x or 0.0 for x in s] for s, _ in rows[:200]])
    for bounds in (np.zeros((4, 0)), mt.score_bounds(sample, 700)):
        pieces = mt.score_pieces(df, bounds, scores="scores", label="label")
        got = {r["index"]: r for r in mt.auc(pieces, score="score", label="label", by=["index"]).collect()}
        ranks = {r["index"]: r["rank_auc"] for r in mt.rank_auc_of_pieces(pieces).collect()}
        assert set(got) == set(want) == set(range(4))
        for k, w in want.items():
            assert (got[k]["n_pos"], got[k]["n_neg"]) == (w["n_pos"], w["n_neg"])
            assert [got[k][c] for c in ("auc", "var", "lower", "upper")] == pytest.approx([w[c] for c in ("auc", "var", "lower", "upper")], abs=1e-12)
            assert ranks[k] == pytest.approx(w["auc"], abs=1e-12)
    one = mt.score_pieces(df.filter("label = 1"), np.zeros((4, 0)), scores="scores", label="label")
    assert [r["auc"] for r in mt.auc(one, score="score", label="label", by=["index"]).collect()] == [None] * 4


def test_rows_of_few_groups_stay_where_they_are(spark):
    """groups that are few are broadcast; no row is shuffled to its group, and the table is made once."""
    from kairos.operators.dedup import keep_large_groups
    rows = spark.createDataFrame([(g, i) for g, n in ((1, 5), (2, 3), (None, 9)) for i in range(n)], "g int, i int")
    kept = keep_large_groups(rows, ["g"], 3, few=True)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, keep_large_groups(rows, ["g"], 3).collect())) == [(1, i) for i in range(5)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan

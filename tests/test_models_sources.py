"""Model fits against numpy references; readers and writers on small files."""

import math
import os
import random

import pytest
import tempfile

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from kairos.operators import models as md
from kairos.sources import readers as rd
from kairos.sources import writers as wr


def _cox_numpy(t, d, X, l2, pf):
    beta = np.zeros(X.shape[1])
    for _ in range(50):
        xb = X @ beta
        e = np.exp(xb)
        g = np.zeros_like(beta)
        h = np.zeros((len(beta), len(beta)))
        for tt in np.unique(t[d == 1]):
            risk = t >= tt
            dead = (t == tt) & (d == 1)
            s0 = e[risk].sum()
            s1 = (X[risk] * e[risk, None]).sum(0)
            s2 = (X[risk, :, None] * X[risk, None, :] * e[risk, None, None]).sum(0)
            nd = dead.sum()
            g += X[dead].sum(0) - nd * s1 / s0
            h -= nd * (s2 / s0 - np.outer(s1, s1) / s0 ** 2)
        g -= l2 * pf * beta
        h -= np.diag(l2 * pf)
        step = np.linalg.solve(h, g)
        beta = beta - step
        if np.abs(step).max() < 1e-12:
            break
    return beta


def test_cox_matches_numpy(spark):
    rng = np.random.default_rng(0)
    n = 200
    X = rng.normal(size=(n, 3))
    t = np.round(rng.exponential(scale=np.exp(-X @ np.array([0.5, -0.3, 0.0]))) * 100)
    d = (rng.random(n) < 0.7).astype(int)
    df = spark.createDataFrame([(float(t[i]), int(d[i]), *map(float, X[i])) for i in range(n)],
                               "t double, d int, x0 double, x1 double, x2 double")
    pf = np.array([1.0, 1.0, 0.0])
    fit = md.cox_fit(df, time="t", event="d", features=["x0", "x1", "x2"], l2=2.0, penalty_factor=pf)
    ref = _cox_numpy(t, d, X, 2.0, pf)
    assert np.allclose(fit["beta"], ref, atol=1e-7)


def test_breslow_baseline(spark):
    df = spark.createDataFrame([(1.0, 1, 0.0), (2.0, 1, 0.0), (2.0, 0, 0.0), (3.0, 1, 0.0)], "t double, d int, x double")
    h = {r["time"]: r["H0"] for r in md.breslow_baseline(df, time="t", event="d", xb=F.lit(0.0)).collect()}
    assert math.isclose(h[1.0], 1 / 4) and math.isclose(h[2.0], 1 / 4 + 1 / 3) and math.isclose(h[3.0], 1 / 4 + 1 / 3 + 1)


def test_person_intervals_and_loss(spark):
    df = spark.createDataFrame([(100.0, True), (137.0, False)], "t double, d boolean")
    pi = md.person_intervals(df, time="t", event="d", keep=["t"]).collect()
    got = sorted((r["t"], r["interval"], r["y"]) for r in pi)
    assert got == [(100.0, 0, 1), (100.0, 1, 1), (100.0, 2, 0), (137.0, 0, 1), (137.0, 1, 1), (137.0, 2, 1)]
    s, f = md.label_arrays("t", "d")
    p = F.array(*[F.lit(0.9)] * 12)
    loss = df.select(md.surv_loss(p, s, f).alias("l")).collect()
    assert math.isclose(loss[0]["l"], -2 * math.log(0.9) - math.log(0.1))
    assert math.isclose(loss[1]["l"], -3 * math.log(0.9))


def test_discrete_time_fit_recovers_direction(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        x = rng.gauss(0, 1)
        t = rng.expovariate(math.exp(0.8 * x) / 400.0)
        rows.append((min(t, 1900.0), t < 1900.0, x))
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.createDataFrame(rows, "t double, d boolean, x double"))
    pi = md.person_intervals(df, time="t", event="d", keep=["features"])
    base, w = md.fit_discrete_time(pi, n_intervals=12, l2=0.001)
    assert w[0] < -0.3  # higher hazard -> lower interval survival probability


@pytest.mark.parametrize("l2", [0.0, 0.01, 0.1, 10.0])
def test_discrete_time_baselines_are_free(spark, l2):
    """Without covariates the baseline of an interval is logit(share that survives it), whatever the penalty."""
    rows = [(k % 3, float(k % 20 != 0), 0.0) for k in range(600)]  # 95 % survive each interval: logit 2.944
    pi = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(rows, "interval int, y double, x double"))
    base, w = md.fit_discrete_time(pi, n_intervals=3, l2=l2)
    assert [round(b, 3) for b in base] == [2.944] * 3 and abs(w[0]) < 1e-6


def test_cox_that_does_not_converge_raises(spark):
    df = spark.createDataFrame([(float(k), k % 2, float(k % 7)) for k in range(60)], "t double, d int, x double")
    with pytest.raises(RuntimeError, match="converge"):
        md.cox_fit(df, time="t", event="d", features=["x"], l2=0.1, max_iter=1)


def test_glm_lr_test(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice("xy")) for _ in range(400)]
    rows = [(a, b, int(rng.random() < (0.7 if a == "a" else 0.3))) for a, b in rows]
    df = spark.createDataFrame(rows, "a string, b string, y int")
    res = md.glm_lr_test(df, label="y", full=["a", "b"], nested=["b"])
    assert res["df"] == 2 and res["lr"] > 10 and res["p"] < 0.01


def test_lambda_max_zeroes_all(spark):
    rng = random.Random(8)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(300)]
    rows = [(a, b, float(rng.random() < 1 / (1 + math.exp(-a)))) for a, b in rows]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    from pyspark.sql import functions as F
    df = df.withColumn("id", F.monotonically_increasing_id())
    long = df.select("id", F.explode(F.array(F.struct(F.lit("a").alias("feature"), F.col("a").alias("value")),
                                             F.struct(F.lit("b").alias("feature"), F.col("b").alias("value")))).alias("e")).select("id", "e.*")
    lm = md.lambda_max_long(long, df, row_id="id").first()["lambda_max"]
    d = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    path = md.lasso_path(d, lambdas=[lm * 1.01, lm * 0.05])
    assert path[0]["df"] == 0 and path[1]["df"] >= 1


def test_lasso_path_equals_mllib_in_shared_passes(spark, monkeypatch):
    """All penalties go through the same passes: no MLlib fit per penalty, and the same coefficients."""
    from pyspark.ml.classification import LogisticRegression
    rng = random.Random(18)
    rows = [(rng.gauss(3, 2), rng.gauss(0, 1)) for _ in range(200)]
    rows = [(a, b, float(rng.random() < 1 / (1 + math.exp(3 - a - b / 2)))) for a, b in rows]
    d = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, label double"))
    lambdas = [0.2, 0.05, 0.01, 0.001]
    models = [LogisticRegression(elasticNetParam=1.0, regParam=lam, standardization=True, maxIter=500, tol=1e-12).fit(d) for lam in lambdas]
    monkeypatch.setattr(LogisticRegression, "fit", lambda *a: pytest.fail("a fit of its own for a penalty"))
    path = md.lasso_path(d, lambdas=lambdas)
    for fit, model in zip(path, models, strict=True):
        assert np.allclose(fit["coef"], model.coefficients.toArray(), atol=1e-4) and abs(fit["intercept"] - model.intercept) < 1e-4
        assert fit["df"] == np.count_nonzero(model.coefficients.toArray())
    assert [f["lambda"] for f in path] == lambdas


def test_packed_texts(spark):
    """Texts that hold separators, escapes, line ends and nothing at all come back as they were, from few files."""
    texts = ["plain", "", None, "two\nlines\r\n", "a\x1eb\x1fc", "back \\ \\e \\s \\\\e\x1e\\", "\x1e", "ü \U0001f600", "x" * 100_000] * 20
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc long, text string").repartition(3)
    path = wr.write_packed_texts(df, wr.shared_path(spark, "packed"))
    back = rd.read_packed_texts(spark, path)
    assert {int(r.doc): r.text for r in back.collect()} == dict(enumerate(texts))
    assert back.select(F.input_file_name()).distinct().count() <= 3
    assert rd.read_packed_texts(spark, wr.write_packed_texts(df.limit(0), wr.shared_path(spark, "packed"))).count() == 0


def test_text_folder_and_extracts(spark):
    base = tempfile.mkdtemp(prefix="kairos-src-")
    for name, body in (("n1", "first note\nline two"), ("n2", "second")):
        with open(os.path.join(base, f"{name}.txt"), "w") as f:
            f.write(body)
    got = {r["doc"]: r["text"] for r in rd.read_text_folder(spark, base).collect()}
    assert got == {"n1": "first note\nline two", "n2": "second"}
    e1, e2 = os.path.join(base, "extract_20200105.csv"), os.path.join(base, "extract_20200201.csv")
    with open(e1, "w") as f:
        f.write("patient_id,score,appt\n1,0.5,2020-01-10\n")
    with open(e2, "w") as f:
        f.write("patient_id,score\n2,0.7\n")
    ex = {r["patient_id"]: r for r in rd.read_extracts(
        spark, [e1, e2], {"patient_id": "bigint", "score": "double", "appt": "date"},
        date_pattern=r"extract_(\d{8})", fill_missing={"appt": 4}).collect()}
    assert str(ex[1]["appt"]) == "2020-01-10" and str(ex[2]["appt"]) == "2020-02-05"


def test_timestamp_detection(spark):
    df = spark.createDataFrame([("2020-01-02 03:04:05", "abc", "2020-01-02 03:04:05.1234567"),
                                (None, "abcdefghijklmnopqrs", "2020-01-02 03:04:05")], "a string, b string, c string")
    assert rd.timestamp_like_columns(df) == ["a", "c"]
    out = rd.convert_timestamps(df).first()
    assert str(out["a"]) == "2020-01-02 03:04:00" and out["b"] == "abc"


def test_persist_table_under_checkpoint_dir(spark):
    df = spark.range(10).withColumn("arr", F.array(F.col("id"), F.col("id") + 1))
    back = wr.persist_table(df, "t")
    assert back.count() == 10 and back.schema["arr"].dataType.simpleString() == "array<bigint>"
    files = back.inputFiles()
    assert files and all(spark.sparkContext.getCheckpointDir().replace("file:", "") in f.replace("file:", "")
                         for f in files)


def test_cox_penalties_are_the_reference_sequence():
    """10^seq(5, -3, -0.1)."""
    from kairos.plans.q_models import COX_LAMBDAS
    assert np.allclose(np.log10(COX_LAMBDAS), np.linspace(5, -3, 81))


def test_cox_cv_against_separate_fits(spark):
    rng = random.Random(12)
    rows = []
    for k in range(150):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        t = rng.expovariate(math.exp(0.7 * x) / 300.0)
        rows.append((round(min(t, 900.0), 0), int(t < 900.0), x, z, k % 3 + 1))
    df = spark.createDataFrame(rows, "t double, d int, x double, z double, fold int")
    lambdas, pf = [10.0, 0.1, 0.001], [1.0, 0.0]
    cv = md.cox_cv(df, time="t", event="d", features=["x", "z"], fold="fold", n_folds=3, lambdas=lambdas, penalty_factor=pf)
    t, d, X = (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([[r[2], r[3]] for r in rows]))
    fold = np.array([r[4] for r in rows])

    def loglik(at, b):
        xb = X[at] @ b
        return sum(xb[i] - np.log(np.exp(xb[t[at] >= t[at][i]]).sum()) for i in range(len(xb)) if d[at][i])

    want = []
    for lam in lambdas:
        total = 0.0
        for k in (1, 2, 3):
            at = fold != k
            b = _cox_numpy(t[at], d[at], X[at], at.sum() * lam / 2, np.array([2.0, 0.0]))
            total += loglik(np.ones(len(t), bool), b) - loglik(at, b)
        want.append(total)
    assert np.allclose(cv["criterion"], want, rtol=1e-6) and cv["best"] == int(np.argmax(want))
    assert np.allclose(cv["beta"], _cox_numpy(t, d, X, len(t) * lambdas[cv["best"]] / 2, np.array([2.0, 0.0])), atol=1e-6)

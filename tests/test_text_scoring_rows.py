"""Text functions, scoring curves, labels, bins, dedup and joins: FIXTURES section 3 cases."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from kairos.functions import bins, text as tx
from kairos.operators import dedup, joins, models as md, rows, scoring as sc
from kairos.operators.running import dense_index, global_row_number, running_sum


def _one(spark, expr, schema, row):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first()["x"]


def test_number_words(spark):
    cases = {"x 3 y": "x three y", "3 y": " y", "x 15.5 mg": "x ten mg", "x 3,200 y": "x  y",
             "x 150 y": "x onehundred y", "x 07 y": "x  y", "a 1 2 b": "a one two b", "no digits": "no digits",
             "x 1,2,3 y": "x onehundred y", "9": "", "a 42": "a "}
    d = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["x"] for r in d.select("t", tx.numbers_to_words("t").alias("x")).collect()}
    assert got == cases


def test_remove_names(spark):
    d = spark.createDataFrame([("ANN annual", "Ann", None), ("Bo (x) bo", "", "(x)")], "t string, f string, l string")
    got = [r["x"] for r in d.select(tx.remove_names("t", "f", "l").alias("x")).collect()]
    assert got == [" ual", "Bo  bo"]


def test_signed_terms(spark):
    got = _one(spark, tx.signed_terms("s"), "s string", (" +age -non-small",))
    assert got == ["+age", "-non", "-small"]


def test_ngrams_and_word_count(spark):
    d = spark.createDataFrame([("Hello, wörld  a bb",)], "t string").select(tx.tokens("t").alias("k"))
    r = d.select(tx.ngrams_1_2("k").alias("g")).first()["g"]
    assert r == ["hello", "wörld", "bb", "hello wörld", "wörld bb"]
    assert _one(spark, tx.word_count("t"), "t string", ("a b c",)) == 1


def test_median_survival_fixture(spark):
    br = [0, 10, 20]
    curve = sc.cumulative_curve(F.array(F.lit(0.8), F.lit(0.5)))
    d = spark.range(1).select(curve.alias("c"))
    r = d.select(F.col("c"), sc.median_survival("c", br).alias("m")).first()
    assert [round(x, 12) for x in r["c"]] == [0.8, 0.4] and r["m"] == 18
    never = spark.range(1).select(sc.median_survival(F.array(F.lit(1.0), F.lit(1.0)), br).alias("m")).first()["m"]
    assert never == 999999


def test_interpolations(spark):
    br = [0, 10, 20]
    c = F.array(F.lit(0.8), F.lit(0.4))
    q = spark.range(1).select(sc.interpolate(c, 5.0, br).alias("a"), sc.interpolate(c, 15.0, br).alias("b"),
                              sc.interpolate(c, 30.0, br).alias("c"), sc.survival_at_day(c, 4.2, br).alias("d"),
                              sc.survival_at_day(c, 25, br).alias("e")).first()
    assert q["a"] == 0.8 and math.isclose(q["b"], 0.6) and q["c"] == 0.4
    assert math.isclose(q["d"], 1 - 0.2 * 5 / 10) and q["e"] == 0.0


def test_label_arrays_fixture(spark):
    d = spark.createDataFrame([(91.0, True), (100.0, True), (137.0, False), (1825.0, True)], "t double, d boolean")
    s, f = md.label_arrays("t", "d")
    got = [(r["s"], r["f"]) for r in d.select(s.alias("s"), f.alias("f")).collect()]
    assert got[0][0][:3] == [1, 1, 0] and got[0][1].index(1) == 2
    assert got[1] == got[0]
    assert got[2][0][:4] == [1, 1, 1, 0] and sum(got[2][1]) == 0
    assert got[3][0] == [1] * 12 and sum(got[3][1]) == 0


def test_cut_edges(spark):
    brk = [365 * x for x in (-1, 0.25, 0.5, 0.75, 1, 1.5, 2, 999999)]
    d = spark.createDataFrame([(91.25,), (91.26,), (-365.0,), (-366.0,)], "x double")
    got = [r["b"] for r in d.select(bins.cut("x", brk).alias("b")).collect()]
    assert got == [1, 2, 1, None]
    assert _one(spark, bins.mean_round_half_down("a", "b"), "a int, b int", (2, 3)) == 2


def test_keep_first_non_null(spark):
    d = spark.createDataFrame([(1, 1, None, 1.0), (1, 2, 2.0, 3.0)], "k int, o int, a double, b double")
    r = dedup.first_non_null(d, ["k"], "o", ["a", "b"]).first()
    assert (r["a"], r["b"]) == (2.0, 1.0)


def test_fourteen_day_chain(spark):
    base = dt.date(2020, 1, 1)
    d = spark.createDataFrame([(1, base + dt.timedelta(days=x)) for x in (0, 10, 20, 40)], "p int, t date")
    kept = sorted((r["t"] - base).days for r in joins.drop_close_followers(d, key="p", time="t").collect())
    assert kept == [0, 40]


def test_asof_ties_kept(spark):
    from kairos.operators.cohort import landmark_set
    v = spark.createDataFrame([(1, 1, 0.0, 500.0, True), (1, 2, 300.0, 200.0, True), (1, 3, 300.0, 200.0, True)],
                              "patient_id long, visit_id long, time1 double, days_to_last double, dead boolean")
    out = landmark_set(v, grid=[365.0]).collect()
    assert sorted(r["visit_id"] for r in out) == [2, 3] and out[0]["fu_time"] == 135.0


def test_nearest_landmark_first_on_tie(spark):
    assert _one(spark, joins.nearest_landmark("t", [0, 10, 20]), "t double", (5.0,)) == 0.0
    assert _one(spark, joins.nearest_landmark("t", [0, 10, 20]), "t double", (16.0,)) == 20.0


def test_running_sum_matches_cumsum(spark):
    rng = random.Random(11)
    rows = [(rng.choice("ab"), float(i), rng.randint(0, 9)) for i in range(500)]
    d = spark.createDataFrame(rows, "g string, t double, v long")
    for desc in (False, True):
        for incl in (True, False):
            got = {(r["g"], r["t"]): r["cum_v"] for r in
                   running_sum(d, ["t"], ["v"], by=["g"], descending=desc, inclusive=incl, n_buckets=7).collect()}
            for g in "ab":
                sub = sorted([(t, v) for gg, t, v in rows if gg == g], reverse=desc)
                acc = 0
                for t, v in sub:
                    if incl:
                        acc += v
                    assert got[(g, t)] == acc
                    if not incl:
                        acc += v


def test_global_row_number_and_dense_index(spark):
    d = spark.createDataFrame([(x,) for x in ["b", "a", "c", "a", "é", "b"]], "s string")
    idx = {r["s"]: r["index"] for r in dense_index(d, "s").collect()}
    assert idx == {"a": 0, "b": 1, "c": 2, "é": 3}
    g = global_row_number(spark.range(100).withColumn("k", -F.col("id")), ["k"], n_buckets=5)
    assert sorted(r["rn"] for r in g.collect()) == list(range(1, 101))


def test_quantile_bins_merge_duplicates(spark):
    d = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 1, 2, 3, 4]], "v double")
    got = sorted(r["qbin"] for r in rows.quantile_bin(d, "v", 4).collect())
    # cuts at the 1st..3rd quarter: 1, 1, 2 -> merged [1, 2]; left-closed groups
    assert got == [2, 2, 2, 2, 2, 3, 3, 3]


def test_split_hash_is_stable(spark):
    d = spark.range(1000).withColumnRenamed("id", "pid")
    a = {r["pid"]: r["s"] for r in d.select("pid", dedup.split_label("pid").alias("s")).collect()}
    b = {r["pid"]: r["s"] for r in d.repartition(7).select("pid", dedup.split_label("pid").alias("s")).collect()}
    assert a == b and 700 < sum(1 for v in a.values() if v == 0) < 900


def test_number_words_are_linear_in_the_note(spark):
    """A note of 100 KB full of digit runs takes about as long as its parts."""
    import time
    from kairos.functions.text import numbers_to_words
    d = spark.createDataFrame([("dose 12 of 3 and 45.7 for 100 days, 1,000 mg " * 2200,)], "t string")
    t = time.time()
    out = d.select(numbers_to_words("t").alias("t")).first()["t"]
    assert time.time() - t < 5 and "dose ten of three and forty for onehundred days" in out


def test_buckets_split_strings_with_a_common_prefix(spark):
    from kairos.operators.running import bucket_bounds
    d = spark.range(2000).select(F.format_string("event:diagnosis_%05d", "id").alias("s"))
    b = d.withColumn("_b", bucket_bounds(d, "s", 16)).select("s", F.size(F.filter("_b", lambda x: x < F.col("s"))).alias("k"))
    sizes = [r["count"] for r in b.groupBy("k").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 400
    idx = {r["s"]: r["index"] for r in dense_index(d, "s").collect()}
    assert all(idx[s] == k for k, s in enumerate(sorted(idx)))


def test_top_contributions_rank_absent_features(spark):
    """The full standardised row is ranked: features a row does not hold count with their fill value."""
    from kairos.operators.scoring import top_contributions
    coefs = spark.createDataFrame([("a", 1.0, 0.0), ("b", 2.0, -0.5), ("c", -1.0, -2.0), ("d", 0.5, 0.0)], "feature string, coef double, fill_z double")
    z = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (2, "c", 1.0)], "visit_id long, feature string, z double")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "visit_id long")
    got = {r["visit_id"]: (r["improve_feats"], r["worsen_feats"]) for r in top_contributions(z, coefs, rows, row_id=["visit_id"], k=2).collect()}
    assert got == {1: (" +a +b", " -d +b"), 2: (" -a -d", " -b +c"), 3: (" -c -a", " -b -a")}


def test_top_contributions_move_places_not_names(spark):
    """Rows and their shuffle hold a feature's place, never its name; ties still go by name, also with repeated entries."""
    from kairos.operators.scoring import top_contributions
    coefs = spark.createDataFrame([("b", 1.0, -1.0), ("a", 1.0, -1.0), ("d", -1.0, 0.0), ("c", 2.0, 0.5)], "feature string, coef double, fill_z double")
    z = spark.createDataFrame([(1, "c", -1.0), (1, "c", -1.0), (1, "d", 1.0), (2, "b", 1.0), (2, "a", 1.0), (2, "x", 9.0)], "visit_id long, feature string, z double")
    rows = spark.createDataFrame([(1,), (1,), (2,), (3,)], "visit_id long")
    out = top_contributions(z, coefs, rows, row_id=["visit_id"], k=2)
    assert {r["visit_id"]: (r["improve_feats"], r["worsen_feats"]) for r in out.collect()} == {
        1: (" -a -b", " -c -c"), 2: (" +a +b", " -d +a"), 3: (" +c -d", " -a -b")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate [visit_id" in line and "_own" in line]
    assert grouped and not any("feature" in line.split("collect_list", 1)[1] for line in grouped)


def test_lemmas_and_stop_words_from_one_count(spark):
    """G5 counts the tokens of the corpus once; lemmas and the stop list both come from those totals."""
    from kairos.operators import text as tops
    from kairos.operators.dedup import top_n_by_frequency
    notes = spark.createDataFrame([(1, "Dogs dog  the The cats"), (2, "the dog gas"), (2, "the dog gas"), (None, "dogs ass"), (3, None), (4, "")],
                                  "note_id int, note_text string")
    totals = tops.token_totals(notes)
    assert {r["token"]: r["n"] for r in totals.collect()} == {"dogs": 2, "dog": 3, "the": 4, "cats": 1, "gas": 2, "ass": 1}
    assert [tuple(r) for r in tops.plural_lemmas(totals).collect()] == [("dogs", "dog")]  # "cat" is no token, "gas" is too short
    top = top_n_by_frequency(totals, "token", 3, count="n").orderBy("rank").collect()
    assert [(r["token"], r["n"]) for r in top] == [("the", 4), ("dog", 3), ("dogs", 2)]

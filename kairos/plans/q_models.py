"""Contract queries: survival labels, losses, curves, explanations
and model fits (H1, H3-H7, I7; rows-only checks, hand-checked in tests)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from kairos.operators import models as md
from kairos.operators import scoring as sc
from kairos.plans.q_cohort import _F1_SQL, _F4_SQL, _LONG_SQL
from kairos.plans.q_metrics import EV_SQL
from kairos.plans.q_survival import LAM_SQL, SV_SQL, surv_base
from kairos.plans.q_text import _COUNTS_SQL as COUNTS_SQL, _VOCAB_SQL as VOCAB_SQL
from kairos.plans.registry import ORACLE, query, r
from kairos.sources.writers import persist_table

_BR = list(sc.BREAKS)
_UP = [float(b) for b in _BR[1:]]
_MID = [a + 0.5 * (b - a) for a, b in zip(_BR[:-1], _BR[1:])]
_WID = [float(b - a) for a, b in zip(_BR[:-1], _BR[1:])]


def _dbl(x) -> str:
    """A DuckDB double literal (plain decimals would be DECIMAL)."""
    s = repr(float(x))
    return s if "e" in s else s + "e0"


def _sql_list(xs) -> str:
    return "[" + ", ".join(_dbl(x) for x in xs) + "]"


_LABEL_SQL = f"""
select patient_id, time, event,
  [{", ".join(f"case when event then (time >= {_dbl(u)})::int else (time >= {_dbl(m)})::int end" for u, m in zip(_UP, _MID))}] as s,
  coalesce(list_position([{", ".join(f"time < {_dbl(u)}" for u in _UP)}], true), 0) as first_fail
from sv
"""


def _rate():
    return (F.lit(1.5) - (F.col("score_a") + F.lit(1000.0)) / F.lit(11000.0)) / F.lit(365.0)


@query("h2_survival_labels", "H2 S14", f"""
select patient_id, array_to_string(s, '') as survived,
  array_to_string(list_transform(range(1, {len(_UP) + 1}), lambda i: case when event and first_fail = i then 1 else 0 end), '') as failed
from lab
""", extra_views={"sv": SV_SQL, "lab": _LABEL_SQL})
def h2_survival_labels(spark, sf_dir):
    b = surv_base(spark, sf_dir)
    s, f = md.label_arrays("time", "event")
    return b.select("patient_id", F.array_join(s, "").alias("survived"), F.array_join(f, "").alias("failed"))


_PROBS_SQL = f"""
select patient_id, time, event, score_a, list_transform({_sql_list(_WID)}, lambda w: exp(-{LAM_SQL} * w)) as p from sv
"""


@query("h8_loss", "H8", f"""
with j as (select l.patient_id, l.s, l.first_fail, l.event, p.p from lab l join probs p on p.patient_id = l.patient_id)
select patient_id, round(list_sum(list_transform(range(1, {len(_UP) + 1}), lambda i:
    -ln(greatest(1e0 + s[i] * (p[i] - 1e0), 1e-7))
    - ln(greatest(1e0 - (case when event and first_fail = i then 1 else 0 end) * p[i], 1e-7)))), 6) as loss
from j
""", extra_views={"sv": SV_SQL, "lab": _LABEL_SQL, "probs": _PROBS_SQL})
def h8_loss(spark, sf_dir):
    b = surv_base(spark, sf_dir)
    s, f = md.label_arrays("time", "event")
    probs = sc.exp_curve(_rate())
    return b.select("patient_id", r(md.surv_loss(probs, s, f), 6).alias("loss"))


_CURVE_SQL = f"""
select patient_id, time, p, list_transform(range(1, {len(_UP) + 1}),
  lambda i: list_reduce(list_slice(p, 1, i), lambda a, b: a * b)) as curve from probs
"""


def _curves(spark, sf_dir):
    b = surv_base(spark, sf_dir)
    return b.select("patient_id", "time", sc.cumulative_curve(sc.exp_curve(_rate())).alias("curve"))


@query("i1_curve", "I1", """
select patient_id, round(curve[4], 8) as s_365, round(curve[12], 8) as s_1825 from cv
""", extra_views={"sv": SV_SQL, "probs": _PROBS_SQL, "cv": _CURVE_SQL})
def i1_curve(spark, sf_dir):
    c = _curves(spark, sf_dir)
    return c.select("patient_id", r(sc.survival_at_break("curve", sc.BREAKS, 365), 8).alias("s_365"),
                    r(sc.survival_at_break("curve", sc.BREAKS, 1825), 8).alias("s_1825"))


@query("i2_median", "I2 S15", f"""
with v as (select patient_id, list_concat([1e0], curve) as vs from cv),
k as (select patient_id, vs, coalesce(list_position(list_transform(vs, lambda x: x < 0.5e0), true), 0) as idx from v),
x as (select patient_id, idx, {_sql_list(_BR)}[greatest(idx - 1, 1)] as t0, {_sql_list(_BR)}[greatest(idx, 1)] as t1,
        vs[greatest(idx - 1, 1)] as s0, vs[greatest(idx, 1)] as s1 from k)
select patient_id, cast(case when idx = 0 then 999999 else floor(t0 + (s0 - 0.5e0) / (s0 - s1) * (t1 - t0)) + 1 end as bigint) as median
from x
""", extra_views={"sv": SV_SQL, "probs": _PROBS_SQL, "cv": _CURVE_SQL})
def i2_median(spark, sf_dir):
    c = _curves(spark, sf_dir)
    return c.select("patient_id", sc.median_survival("curve").alias("median"))


def _interp_sql(ts, vs, t) -> str:
    """DuckDB text of the piecewise-linear value at t (t inside [ts[1], ts[-1]])."""
    j = f"coalesce(list_position(list_transform({ts}, lambda x: x >= {t}), true), 0)"
    jj = f"greatest({j}, 2)"
    return (f"case when {j} = 0 then {vs}[len({vs})] when {j} = 1 then {vs}[1] else "
            f"{vs}[{jj} - 1] + ({vs}[{jj}] - {vs}[{jj} - 1]) * ({t} - {ts}[{jj} - 1]) / ({ts}[{jj}] - {ts}[{jj} - 1]) end")


@query("i3_at_day", "I3 S15", f"""
with v as (select patient_id, list_concat([1e0], curve) as vs from cv)
select patient_id, round({_interp_sql(_sql_list(_BR), 'vs', '182e0')}, 8) as at_182,
  round({_interp_sql(_sql_list(_BR), 'vs', '365e0')}, 8) as at_365
from v
""", extra_views={"sv": SV_SQL, "probs": _PROBS_SQL, "cv": _CURVE_SQL})
def i3_at_day(spark, sf_dir):
    c = _curves(spark, sf_dir)
    return c.select("patient_id", r(sc.survival_at_day("curve", 181.5), 8).alias("at_182"),
                    r(sc.survival_at_day("curve", 365), 8).alias("at_365"))


@query("i4_interp", "I4 S15", f"""
select patient_id, round({_interp_sql(_sql_list(_UP), 'curve', 'cast(time as double)')}, 8) as at_fu from cv
""", extra_views={"sv": SV_SQL, "probs": _PROBS_SQL, "cv": _CURVE_SQL})
def i4_interp(spark, sf_dir):
    c = _curves(spark, sf_dir)
    return c.select("patient_id", r(sc.interpolate("curve", F.col("time").cast("double")), 8).alias("at_fu"))


# --- I5: Breslow curves with a fixed coefficient -----------------------------

_GRID = [i * 365.0 / 16 for i in range(81)]
_BETA = -0.0002

_H0_SQL = f"""
with t as (select cast(time as double) as time, sum(case when event then 1 else 0 end) as d,
             sum(exp({_BETA} * score_a)) as s0 from sv group by time),
r as (select time, d, sum(s0) over (order by time desc rows between unbounded preceding and current row) as rs0 from t)
select time, sum(d / rs0) over (order by time rows between unbounded preceding and current row) as h0 from r
"""


@query("i5_cox_curves", "I5 H4", f"""
with g as (select unnest({_sql_list(_GRID)}) as gt),
hg as (select g.gt, coalesce(max_by(h.h0, h.time), 0e0) as h0 from g left join h0t h on h.time <= g.gt group by g.gt),
c as (select s.patient_id, hg.gt, exp(-hg.h0 * exp({_BETA} * s.score_a)) as surv from sv s, hg),
m as (select patient_id, min(case when surv < 0.5e0 then gt end) as first_below,
        max(case when gt = 365e0 then surv end) as s_365 from c group by patient_id)
select patient_id, round(s_365, 8) as s_365, coalesce(first_below, 1825e0) as median_grid from m
""", extra_views={"sv": SV_SQL, "h0t": _H0_SQL})
def i5_cox_curves(spark, sf_dir):
    b = surv_base(spark, sf_dir)
    xb = F.lit(_BETA) * F.col("score_a")
    h0 = md.breslow_baseline(b, time="time", event="event", xb=xb)
    cur = sc.breslow_curves(h0, b.withColumn("xb", xb), row_id=["patient_id"], grid=_GRID)
    return cur.select("patient_id", r(F.element_at("curve", 17), 8).alias("s_365"), "median_grid")


# --- I6: top / bottom contributions over the standardised feature rows ----------


def _long_z(spark, sf_dir):
    from kairos.operators import features
    from kairos.plans.q_cohort import _assembled
    from kairos.sources import fixtures as fx
    long = _assembled(spark, sf_dir, materialize=True)
    ev = fx.visits(spark, sf_dir).select("visit_id", (F.col("patient_id") % 10 < 8).alias("is_train"))
    z, st = features.impute_standardize(long, ev, zero_filled=["event"])
    return long, z, st


@query("i6_top_features", "I6 F10 F11 D13", """
with ev as (select visit_id, patient_id % 10 < 8 as is_train from visits),
ntr as (select count(*) as n from ev where is_train),
tr as (select l.* from longf l join ev on ev.visit_id = l.visit_id where ev.is_train),
a as (select feature, category, count(value) as n, sum(value) as s, sum(value * value) as ss,
        stddev_pop(value) as sdp, avg(value) as m from tr group by feature, category),
st as (select feature, category,
         case when category = 'event' then s / (select n from ntr) else m end as mean,
         case when category = 'event' then sqrt(greatest(ss / (select n from ntr) - pow(s / (select n from ntr), 2), 0e0)) else sdp end as std
       from a),
dict as (select feature, row_number() over (order by feature) - 1 as idx from st),
co as (select dict.feature, ((idx % 7) - 3) / 10e0 as coef, case when category = 'event' then -mean / std else 0e0 end as fill_z,
         mean, std from dict join st on st.feature = dict.feature where std > 1e-12),
z as (select ev.visit_id, co.feature, case when l.value is null then co.fill_z else (l.value - co.mean) / co.std end as z
      from ev cross join co left join longf l on l.visit_id = ev.visit_id and l.feature = co.feature),
c as (select z.visit_id, z.feature, z.z * co.coef as contrib,
        case when z.z > 0 then ' +' else ' -' end || z.feature as s from z join co on co.feature = z.feature),
k as (select *, row_number() over (partition by visit_id order by contrib desc, feature) as ru,
        row_number() over (partition by visit_id order by contrib asc, feature) as rd from c)
select visit_id, coalesce(string_agg(case when ru <= 5 then s end, '' order by ru), '') as improve_feats,
  coalesce(string_agg(case when rd <= 5 then s end, '' order by rd), '') as worsen_feats
from k where ru <= 5 or rd <= 5 group by visit_id
""", extra_views={"f1": _F1_SQL, "f4": _F4_SQL, "longf": _LONG_SQL})
def i6_top_features(spark, sf_dir):
    from kairos.operators.running import dense_index
    from kairos.sources import fixtures as fx
    _, z, st = _long_z(spark, sf_dir)
    st = persist_table(st, "feature_stats")  # one row per feature, used by both sides below
    coefs = dense_index(st, "feature", out="idx").join(st.filter("include"), "feature").select(
        "feature", (((F.col("idx") % 7) - 3) / F.lit(10.0)).alias("coef"), "fill_z")
    return sc.top_contributions(z, coefs, fx.visits(spark, sf_dir), row_id=["visit_id"], k=5)


@query("k15_terms_by_side", "K15 B20 I6", "with i6 as (" + ORACLE["i6_top_features"] + r"""
), t as (select 'improve' as side, trim(unnest(regexp_extract_all(improve_feats, '[+-][^+-]*'))) as term from i6
         union all select 'worsen', trim(unnest(regexp_extract_all(worsen_feats, '[+-][^+-]*'))) from i6)
select side, term, cast(count(*) as bigint) as n from t where length(term) > 1 group by side, term
""")
def k15_terms_by_side(spark, sf_dir):
    """Terms of the improving and of the worsening features of every visit, counted apart, each with both signs."""
    from kairos.functions.text import signed_terms
    from kairos.operators.metrics import term_counts
    sides = i6_top_features(spark, sf_dir).select(F.explode(F.array(
        F.struct(F.lit("improve").alias("side"), F.col("improve_feats").alias("f")),
        F.struct(F.lit("worsen").alias("side"), F.col("worsen_feats").alias("f")))).alias("e"))
    return term_counts(sides.select("e.side", signed_terms("e.f").alias("terms")), "terms", by=["side"]).select("side", "term", "n")


# --- model fits (rows-only in the driver; checked by hand cases in tests) -------


def _patient_design(spark, sf_dir):
    b = surv_base(spark, sf_dir)
    st = b.agg(F.avg("score_a").alias("ms"), F.stddev_pop("score_a").alias("ss"),
               F.avg("n_visits").alias("mv"), F.stddev_pop("n_visits").alias("sv"))
    from kairos.operators.rows import attach
    b = attach(b, st, [])
    b = b.withColumn("z_score", (F.col("score_a") - F.col("ms")) / F.col("ss")) \
         .withColumn("z_visits", (F.col("n_visits") - F.col("mv")) / F.col("sv"))
    return VectorAssembler(inputCols=["z_score", "z_visits"], outputCol="features").transform(b)


_INTERVAL_SQL = f"""
select x.patient_id, i.k - 1 as interval, 1 as y from lab x, (select unnest(range(1, {len(_UP) + 1})) as k) i where x.s[i.k] = 1
union all
select x.patient_id, x.first_fail - 1, 0 from lab x where x.event and x.first_fail > 0
"""


@query("h3_discrete_time", "H3 H2", """
select 'interval_' || interval as term, cast(count(*) as bigint) as n, round(sum(y) * 1e0, 3) + 0e0 as fitted, 0e0 as residual
from iv group by interval having sum(y) > 0 and sum(y) < count(*)
union all select 'z_score', cast(count(*) as bigint), null, 0e0 from iv
union all select 'z_visits', cast(count(*) as bigint), null, 0e0 from iv
""", extra_views={"sv": SV_SQL, "lab": _LABEL_SQL, "iv": _INTERVAL_SQL})
def h3_discrete_time(spark, sf_dir):
    """The optimality conditions of the fit, which SQL can check: with free baselines the fitted survivors of each
    interval equal the observed ones, and the penalised gradient of each covariate is zero.

    Intervals without a failure (or without a survivor) have no finite baseline and are left out.
    """
    from pyspark.ml.functions import vector_to_array
    l2 = 0.1
    d = _patient_design(spark, sf_dir)
    pi = persist_table(md.person_intervals(d, time="time", event="event", keep=["patient_id", "features"]), "person_intervals")
    base, w = md.fit_discrete_time(pi, n_intervals=len(_UP), l2=l2)
    p = md.interval_probs(pi, base, w).withColumn("p", F.element_at("probs", F.col("interval") + 1)) \
        .withColumn("x", vector_to_array("features"))
    per = p.groupBy("interval").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("fitted"), F.sum("y").alias("_y"))
    rows = per.filter("_y > 0 and _y < n").select(
        F.concat(F.lit("interval_"), F.col("interval").cast("string")).alias("term"), "n", r("fitted", 3).alias("fitted"), F.lit(0.0).alias("residual"))
    for k, term in enumerate(("z_score", "z_visits")):
        grad = F.sum((F.col("p") - F.col("y")) * F.col("x")[k]) / F.count(F.lit(1)) + F.lit(l2 * float(w[k]))
        rows = rows.unionByName(p.agg(F.count(F.lit(1)).alias("n"), r(grad, 6).alias("residual")).select(
            F.lit(term).alias("term"), "n", F.lit(None).cast("double").alias("fitted"), (F.col("residual") + F.lit(0.0)).alias("residual")))
    return rows


COX_FOLDS = 10
# The ridge Cox penalties, 10^5 down to 10^-3 in tenths of an exponent.
COX_LAMBDAS = tuple(10.0 ** (5 - k / 10) for k in range(81))


@query("h7_glm_lr_test", "H7")
def h7_glm_lr_test(spark, sf_dir):
    from kairos.plans.q_metrics import evaluable
    ev = evaluable(spark, sf_dir).withColumn("grp", (F.col("cluster_id") % 4).cast("string"))
    res = md.glm_lr_test(ev, label="died_1y", full=["site", "grp"], nested=["grp"])
    rows = [("deviance_full", float(res["deviance_full"])), ("deviance_nested", float(res["deviance_nested"])),
            ("lr", float(res["lr"])), ("df", float(res["df"])), ("p", float(res["p"]))]
    return spark.createDataFrame(rows, "name string, value double")


@query("h7_conditions", "H7", """
with d as (select site, cast(cluster_id % 4 as varchar) as grp, cast(died_1y as int) as y from ev),
g as (select grp, count(*) as n, sum(y) as y from d group by grp),
dev as (select -2 * sum(case when y > 0 then y * ln(y / n) else 0e0 end + case when y < n then (n - y) * ln((n - y) / n) else 0e0 end) as v from g),
l as (select 'site' as predictor, site as level, y from d union all select 'grp', grp, y from d)
select predictor, level, cast(count(*) as bigint) as n, cast(sum(y) as bigint) as observed, 0e0 as residual,
  cast((select count(distinct site) - 1 from d) as int) as df, (select round(v, 4) from dev) as deviance_nested
from l group by predictor, level
""", extra_views={"sv": SV_SQL, "ev": EV_SQL})
def h7_conditions(spark, sf_dir):
    """The GLM's optimality conditions: per level of each predictor the fitted events are the observed ones. The nested model has one
    predictor, so its deviance follows from the cell counts, which SQL adds up."""
    from kairos.plans.q_metrics import evaluable
    ev = evaluable(spark, sf_dir).withColumn("grp", (F.col("cluster_id") % 4).cast("string"))
    res = md.glm_lr_test(ev.select("site", "grp", "died_1y"), label="died_1y", full=["site", "grp"], nested=["grp"])
    each = res["rows"].select(F.col("died_1y").cast("int").alias("y"), "fitted", F.explode(F.array(*[
        F.struct(F.lit(c).alias("predictor"), F.col(c).alias("level")) for c in ("site", "grp")])).alias("l"))
    per = each.groupBy("l.predictor", "l.level").agg(F.count("*").alias("n"), F.sum("y").alias("observed"), F.sum("fitted").alias("_f"))
    return per.select("predictor", "level", "n", F.col("observed").cast("long").alias("observed"),
                      (F.round(F.col("_f") - F.col("observed"), 4) + F.lit(0.0)).alias("residual"), F.lit(res["df"]).alias("df"),
                      F.lit(round(float(res["deviance_nested"]), 4)).alias("deviance_nested"))


_LAMBDA_SQL = """
select y.note_id, y.label, c.term, c.cnt * 1e0 as x
from (select note_id, surv_12mo * 1e0 as label from note_outcome where is_train) y join counts c on c.note_id = y.note_id
join vocab v on v.term = c.term
"""


@query("h1_lambda_max", "H1 S13", """
with t as (select note_id, surv_12mo * 1e0 as label from note_outcome where is_train),
g as (select count(*) as n, avg(label) as ybar from t),
f as (select term, sum(x) / max(g.n) as mx, sqrt(greatest(sum(x * x) / max(g.n) - pow(sum(x) / max(g.n), 2), 0e0)) as sx,
        sum(x * label) / max(g.n) as xy, max(g.ybar) as ybar from xs, g group by term)
select cast((select n from g) as bigint) as n_rows, cast(count(*) as bigint) as n_features,
  round(max(case when sx > 0 then abs(xy - mx * ybar) / sx end), 6) as lambda_max
from f
""", extra_views={"counts": COUNTS_SQL, "vocab": VOCAB_SQL, "xs": _LAMBDA_SQL})
def h1_lambda_max(spark, sf_dir):
    """Start of the L1 path over all vocabulary terms of the training notes, from one aggregate per term."""
    from kairos.plans.q_text import VOCAB_N, _vocab
    from kairos.operators import text as tops
    from kairos.sources import fixtures as fx
    n = fx.notes(spark, sf_dir)
    y = fx.note_outcome(spark, sf_dir).filter("is_train").select("note_id", F.col("surv_12mo").cast("double").alias("label"))
    x = tops.vocab_counts(n.join(y.select("note_id"), "note_id", "left_semi"), _vocab(n, VOCAB_N, materialize=True))
    res = md.lambda_max_long(x.withColumn("value", F.col("count").cast("double")), y, row_id="note_id", feature="term")
    return res.select("n_rows", "n_features", r("lambda_max", 6).alias("lambda_max"))


@query("h1_lasso_path", "H1 S13")
def h1_lasso_path(spark, sf_dir):
    from kairos.plans.q_metrics import evaluable
    d = _patient_design(spark, sf_dir)
    ev = evaluable(spark, sf_dir).select("patient_id", F.col("died_1y").cast("double").alias("label"))
    d = persist_table(d.join(ev, "patient_id").select("patient_id", "z_score", "z_visits", "features", "label"), "patient_design")
    long = d.select("patient_id", F.explode(F.array(F.struct(F.lit("z_score").alias("f"), F.col("z_score").alias("v")),
                                                    F.struct(F.lit("z_visits").alias("f"), F.col("z_visits").alias("v")))).alias("e"))
    lmax = md.lambda_max_long(long.select("patient_id", F.col("e.f").alias("feature"), F.col("e.v").alias("value")),
                              d.select("patient_id", "label"), row_id="patient_id").first()["lambda_max"] or 0.0
    lambdas = [lmax * (0.001 ** (i / 80)) for i in range(81)] if lmax > 0 else [0.0]
    path = md.lasso_path(d, lambdas=lambdas)
    at = md.select_lambda(path, rule="index", index=30)
    return spark.createDataFrame([(float(p["lambda"]), int(p["df"]), i == at) for i, p in enumerate(path)], "lambda double, df int, chosen boolean")

"""Contract queries: survival statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairos.functions import bins, dates
from kairos.operators import survival as sv
from kairos.plans.registry import query, r
from kairos.sources import fixtures as fx

FU_SQL = "greatest(datediff('day', earliest_mets, death_date), datediff('day', earliest_mets, lfu_date))"
# predicted survival from a fixed formula of the patient's score: exponential with
# daily hazard lam = (1.5 - (score_a + 1000)/11000) / 365
LAM_SQL = "((1.5e0 - (score_a + 1000e0) / 11000e0) / 365e0)"

SV_SQL = f"""
select patient_id, site, cluster_id, cast({FU_SQL} as int) as time, dead as event, score_a, n_visits,
  exp(-{LAM_SQL} * 365e0) as pred_365, ln(2e0) / {LAM_SQL} as pred_median
from patients where {FU_SQL} is not null
"""


def surv_base(spark, sf_dir):
    p = fx.patients(spark, sf_dir)
    lam = (F.lit(1.5) - (F.col("score_a") + F.lit(1000.0)) / F.lit(11000.0)) / F.lit(365.0)
    t = dates.follow_up_days("death_date", "lfu_date", "earliest_mets").cast("int")
    return p.select("patient_id", "site", "cluster_id", t.alias("time"), F.col("dead").alias("event"), "score_a",
                    "n_visits", F.exp(-lam * F.lit(365.0)).alias("pred_365"),
                    (F.log(F.lit(2.0)) / lam).alias("pred_median")).filter(F.col("time").isNotNull())


def km_sql(src: str, strata: list[str], conf: str = "log") -> str:
    """DuckDB text of the Kaplan-Meier table over ``src(time, event, strata...)``."""
    st = ", ".join(strata)
    stc = (st + ", ") if strata else ""
    part = f"partition by {st}" if strata else ""
    lo = "surv * exp(-1.959963984540054e0 * sqrt(gw))"
    hi = "least(surv * exp(1.959963984540054e0 * sqrt(gw)), 1e0)"
    if conf != "log":
        lo = "pow(surv, exp(1.959963984540054e0 * sqrt(gw) / abs(ln(surv))))"
        hi = "pow(surv, exp(-1.959963984540054e0 * sqrt(gw) / abs(ln(surv))))"
    return f"""
select {stc}time, n_risk, n_event, n_censor, surv,
  case when surv > 0 then surv * sqrt(gw) end as std_err,
  case when surv > 0 then {lo} end as lower, case when surv > 0 then {hi} end as upper
from (
  select {stc}time, n_risk, n_event, n_total - n_event as n_censor,
    case when z > 0 then 0e0 else exp(lf) end as surv, gw
  from (
    select *, sum(case when n_event < n_risk then ln(1e0 - n_event / n_risk) else 0e0 end)
                over ({part} order by time rows between unbounded preceding and current row) as lf,
              sum(case when n_event < n_risk then n_event / (n_risk * (n_risk - n_event)) else 0e0 end)
                over ({part} order by time rows between unbounded preceding and current row) as gw,
              sum(case when n_event >= n_risk then 1 else 0 end)
                over ({part} order by time rows between unbounded preceding and current row) as z
    from (
      select {stc}time, n_total, n_event,
        cast(sum(n_total) over ({part} order by time desc rows between unbounded preceding and current row) as bigint) as n_risk
      from (select {stc}time, cast(count(*) as bigint) as n_total, cast(sum(case when event then 1 else 0 end) as bigint) as n_event
            from {src} where time is not null and event is not null group by {stc}time))))
"""


def _round_km(df, strata):
    return df.select(*strata, "time", "n_risk", "n_event", "n_censor", r("surv", 6).alias("surv"),
                     r("std_err", 6).alias("std_err"), r("lower", 6).alias("lower"), r("upper", 6).alias("upper"))


@query("j1_km", "J1 S16", """
select site, time, n_risk, n_event, n_censor, round(surv, 6) as surv, round(std_err, 6) as std_err,
  round(lower, 6) as lower, round(upper, 6) as upper from km
""", extra_views={"sv": SV_SQL, "km": km_sql("sv", ["site"])})
def j1_km(spark, sf_dir):
    km = sv.km_table(surv_base(spark, sf_dir), time="time", event="event", strata=["site"])
    return _round_km(km, ["site"])


_AT = [182.5, 365.0, 730.0]


@query("j2_surv_at", "J2", """
with g as (select s.site, a.at from (select distinct site from km) s, (select unnest([182.5e0, 365e0, 730e0]) as at) a),
b as (select g.site, g.at, max_by(k.surv, k.time) as surv, max_by(k.std_err, k.time) as std_err,
        max_by(k.lower, k.time) as lower, max_by(k.upper, k.time) as upper
      from g join km k on k.site = g.site and k.time <= g.at group by g.site, g.at),
n as (select g.site, g.at, min_by(k.n_risk, k.time) as n_risk from g join km k on k.site = g.site and k.time >= g.at
      group by g.site, g.at)
select g.site, g.at, round(coalesce(b.surv, 1e0), 6) as surv, round(coalesce(b.std_err, 0e0), 6) as std_err,
  round(coalesce(b.lower, 1e0), 6) as lower, round(coalesce(b.upper, 1e0), 6) as upper,
  coalesce(n.n_risk, 0) as n_risk
from g left join b on b.site = g.site and b.at = g.at left join n on n.site = g.site and n.at = g.at
""", extra_views={"sv": SV_SQL, "km": km_sql("sv", ["site"])})
def j2_surv_at(spark, sf_dir):
    km = sv.km_table(surv_base(spark, sf_dir), strata=["site"])
    out = sv.surv_at(km, _AT, strata=["site"])
    return out.select("site", "at", r("surv", 6).alias("surv"), r("std_err", 6).alias("std_err"),
                      r("lower", 6).alias("lower"), r("upper", 6).alias("upper"), "n_risk")


@query("j3_median", "J3", """
with e as (select * from km where n_event > 0),
f as (select site, min(case when surv <= 0.5e0 + 1e-12 then time end) as t1,
        min(case when surv < 0.5e0 - 1e-12 then time end) as t2,
        min(case when lower <= 0.5e0 + 1e-12 then time end) as lower,
        min(case when upper <= 0.5e0 + 1e-12 then time end) as upper,
        cast(sum(n_event) as bigint) as events from e group by site),
x as (select e.site, max(case when abs(e.surv - 0.5e0) <= 1e-12 then 1 else 0 end) as exact
      from e join f on f.site = e.site and e.time = f.t1 group by e.site),
n as (select site, max(n_risk) as n from km group by site)
select f.site, n.n, f.events,
  cast(case when x.exact = 1 then (f.t1 + coalesce(f.t2, f.t1)) / 2e0 else f.t1 end as double) as median,
  cast(f.lower as double) as lower, cast(f.upper as double) as upper
from f join n on n.site = f.site left join x on x.site = f.site
""", extra_views={"sv": SV_SQL, "km": km_sql("sv", ["site"])})
def j3_median(spark, sf_dir):
    km = sv.km_table(surv_base(spark, sf_dir), strata=["site"])
    return sv.median_survival(km, strata=["site"])


@query("j4_logrank_oe", "J4", """
with t as (select time, cast(sum(case when event then 1 else 0 end) as double) as d, count(*) as n0
           from sv group by time having sum(case when event then 1 else 0 end) > 0),
g as (select t.time, t.d, s.site,
        (select count(*) from sv x where x.site = s.site and x.time >= t.time) as n_g,
        (select count(*) from sv x where x.site = s.site and x.time = t.time and x.event) as d_g
      from t, (select distinct site from sv) s),
n as (select time, sum(n_g) as n from g group by time)
select g.site, cast(sum(d_g) as double) as observed, round(sum(n_g * g.d / n.n), 4) as expected,
  round(sum(case when n.n > 1 then g.d * (n.n - g.d) / (n.n - 1) else 0e0 end * n_g / n.n * (1e0 - n_g / n.n)), 4) as variance
from g join n on n.time = g.time group by g.site
""", extra_views={"sv": SV_SQL})
def j4_logrank_oe(spark, sf_dir):
    parts = sv.logrank_parts(surv_base(spark, sf_dir), group="site")
    d = parts.filter(F.col("g") == F.col("h"))
    return d.select(F.col("g").alias("site"), F.col("o").cast("double").alias("observed"),
                    r("e").alias("expected"), r("v").alias("variance"))


_CIDX_SQL = """
with p as (select a.site, a.patient_id as ai, b.patient_id as bi,
             case when a.score_a < b.score_a then 1 when a.score_a > b.score_a then -1 else 0 end as sgn
           from sv a join sv b on a.site = b.site and a.event and (a.time < b.time or (a.time = b.time and not b.event))),
tot as (select site, count(*) as comparable, sum(case when sgn = 1 then 1 else 0 end) as conc,
          sum(case when sgn = -1 then 1 else 0 end) as disc, sum(case when sgn = 0 then 1 else 0 end) as tied
        from p group by site),
m as (select site, ai as id, sgn from p union all select site, bi, sgn from p),
rw as (select s.site, s.patient_id, coalesce(count(m.sgn), 0) * 1e0 as r, coalesce(sum(m.sgn), 0) * 1e0 as w
       from sv s left join m on m.site = s.site and m.id = s.patient_id group by s.site, s.patient_id),
agg as (select site, count(*) as n, sum(r) as sr, sum(w) as sw, sum(r * r) as srr, sum(w * w) as sww, sum(r * w) as srw
        from rw group by site)
select tot.site, cast(agg.n as bigint) as n, cast(comparable as bigint) as comparable, cast(conc as bigint) as concordant,
  cast(disc as bigint) as discordant, cast(tied as bigint) as tied,
  round((conc + 0.5e0 * tied) / comparable, 6) as cindex,
  round(sqrt(greatest(sr * sr * sww - 2 * sr * sw * srw + sw * sw * srr, 0e0)) / (sr * sr), 6) as se
from tot join agg on agg.site = tot.site
"""


@query("j5_cindex", "J5 S17", _CIDX_SQL, extra_views={"sv": SV_SQL})
def j5_cindex(spark, sf_dir):
    c = sv.cindex(surv_base(spark, sf_dir), time="time", event="event", score="score_a", by=["site"])
    return c.select("site", "n", "comparable", "concordant", "discordant", "tied", r("cindex", 6).alias("cindex"),
                    r("se", 6).alias("se"))


_CAL_SRC = """
with c as (select pred_365, count(*) as n from sv group by pred_365),
cum as (select pred_365, sum(n) over (order by pred_365 rows between unbounded preceding and current row) as cum,
        sum(n) over () as tot from c),
cuts as (select k, min(pred_365) as cut from cum, (select unnest([1, 2, 3, 4]) as k) ks where cum * 5 >= k * tot group by k)
select s.*, cast(1 + (select count(distinct cut) from cuts where cuts.cut <= s.pred_365) as int) as bin from sv s
"""


@query("j6_calibration", "J6 B15 S16", """
with b0 as (select bin, max(time) as t0 from km where time <= 365 group by bin),
b as (select k.bin, b0.t0, k.surv as s0, k.lower as l0, k.upper as u0 from km k join b0 on b0.bin = k.bin and k.time = b0.t0),
a0 as (select bin, min(time) as t1 from km where time > 365 group by bin),
a as (select k.bin, a0.t1, k.surv as s1, k.lower as l1, k.upper as u1 from km k join a0 on a0.bin = k.bin and k.time = a0.t1),
m as (select bin, count(*) as n, avg(pred_365) as predicted from binned group by bin),
i as (select m.bin, m.n, m.predicted, coalesce(b.t0, 0e0) as t0, coalesce(b.s0, 1e0) as s0, coalesce(b.l0, 1e0) as l0,
        coalesce(b.u0, 1e0) as u0, a.t1, a.s1, a.l1, a.u1
      from m left join b on b.bin = m.bin left join a on a.bin = m.bin)
select bin, cast(n as bigint) as n, round(predicted, 6) as predicted,
  round(case when s1 is null then s0 else s0 + (s1 - s0) * (365e0 - t0) / (t1 - t0) end, 6) as observed,
  round(case when l1 is null then l0 else l0 + (l1 - l0) * (365e0 - t0) / (t1 - t0) end, 6) as lower,
  round(case when u1 is null then u0 else u0 + (u1 - u0) * (365e0 - t0) / (t1 - t0) end, 6) as upper
from i
""", extra_views={"sv": SV_SQL, "binned": _CAL_SRC, "km": km_sql("binned", ["bin"], conf="log-log")})
def j6_calibration(spark, sf_dir):
    c = sv.calibration_at(surv_base(spark, sf_dir), pred="pred_365", time="time", event="event", at=365.0, g=5)
    return c.select("bin", "n", r("predicted", 6).alias("predicted"), r("observed", 6).alias("observed"),
                    r("lower", 6).alias("lower"), r("upper", 6).alias("upper"))


@query("j8_at_risk", "J8", """
select site, a.at, cast(count(*) filter (where time >= a.at) as bigint) as n_risk
from sv, (select unnest([0e0, 365e0, 730e0, 1095e0]) as at) a group by site, a.at
""", extra_views={"sv": SV_SQL})
def j8_at_risk(spark, sf_dir):
    return sv.at_risk(surv_base(spark, sf_dir), [0, 365, 730, 1095], strata=["site"])


@query("j9_cutoffs", "J9 J1 J2", """
with gs as (select distinct g from km),
b as (select g, max(time) as t0 from km where time <= 365 group by g)
select gs.g as long_pred, round(coalesce(k.surv, 1e0), 6) as surv_365, round(coalesce(k.lower, 1e0), 6) as lower,
  round(coalesce(k.upper, 1e0), 6) as upper
from gs left join b on b.g = gs.g left join km k on k.g = b.g and k.time = b.t0
""", extra_views={"sv": SV_SQL, "svg": "select time, event, pred_median > 365e0 as g from sv",
                  "km": km_sql("svg", ["g"])})
def j9_cutoffs(spark, sf_dir):
    base = surv_base(spark, sf_dir).withColumn("long_pred", F.col("pred_median") > 365.0)
    km = sv.km_table(base, strata=["long_pred"])
    at = sv.surv_at(km, [365.0], strata=["long_pred"], cols=("surv", "lower", "upper"))
    return at.select("long_pred", r("surv", 6).alias("surv_365"), r("lower", 6).alias("lower"),
                     r("upper", 6).alias("upper"))


# Prognosis bins in days (right-closed, lowest included).
_BREAKS = [365 * x for x in (-1, 0.25, 0.5, 0.75, 1, 1.5, 2, 999999)]


def _bin_sql(x: str) -> str:
    b = _BREAKS
    parts = [f"when {x} >= {b[0]}e0 and {x} <= {b[1]}e0 then 1"]
    for i in range(1, len(b) - 1):
        parts.append(f"when {x} > {b[i]}e0 and {x} <= {b[i + 1]}e0 then {i + 1}")
    return "case " + " ".join(parts) + " end"


@query("j10_errors", "J10 B14 B23", f"""
with d as (select {_bin_sql('time')} as actual, {_bin_sql('pred_median')} as m_score,
             {_bin_sql('n_visits * 60e0')} as m_visits from sv where event),
u as (select 'score' as method, m_score - actual as error from d union all
      select 'visits', m_visits - actual from d)
select method, error, cast(count(*) as bigint) as n from u group by method, error
""", extra_views={"sv": SV_SQL})
def j10_errors(spark, sf_dir):
    from kairos.operators.rows import unpivot
    base = surv_base(spark, sf_dir).filter("event")
    d = base.select(bins.cut("time", _BREAKS).alias("actual"),
                    (bins.cut("pred_median", _BREAKS) - bins.cut("time", _BREAKS)).alias("score"),
                    (bins.cut(F.col("n_visits") * 60.0, _BREAKS) - bins.cut("time", _BREAKS)).alias("visits"))
    long = unpivot(d, ["actual"], ["score", "visits"], "method", "error")
    return long.groupBy("method", "error").agg(F.count(F.lit(1)).alias("n"))


_CAL4_SRC = """
with c as (select pred_median, count(*) as n from sv group by pred_median),
cum as (select pred_median, sum(n) over (order by pred_median rows between unbounded preceding and current row) as cum,
        sum(n) over () as tot from c),
cuts as (select k, min(pred_median) as cut from cum, (select unnest([1, 2, 3]) as k) ks where cum * 4 >= k * tot group by k)
select s.*, cast(1 + (select count(distinct cut) from cuts where cuts.cut <= s.pred_median) as int) as bin from sv s
"""
# Break points of the discrete-time curve (days).
_CURVE_BREAKS = [0, 30, 91, 182, 365, 548, 730, 913, 1095, 1278, 1470, 1643, 1825]


@query("j7_calibration_curves", "J7 J1 J2 B15 I1", f"""
with g as (select unnest(range(0, 12)) as k, unnest({[float(b) for b in _CURVE_BREAKS[1:]]}::double[]) as gt),
pc as (select b.bin, g.k, g.gt, avg(exp(-{LAM_SQL} * g.gt)) as predicted from binned b, g group by b.bin, g.k, g.gt),
ob as (select pc.bin, pc.k, max_by(km.surv, km.time) as surv from pc left join km on km.bin = pc.bin and km.time <= pc.gt
       group by pc.bin, pc.k)
select pc.bin, pc.k, pc.gt as at, round(pc.predicted, 6) as predicted, round(coalesce(ob.surv, 1e0), 6) as observed
from pc join ob on ob.bin = pc.bin and ob.k = pc.k
""", extra_views={"sv": SV_SQL, "binned": _CAL4_SRC, "km": km_sql("binned", ["bin"])})
def j7_calibration_curves(spark, sf_dir):
    from kairos.operators import scoring as sc
    base = surv_base(spark, sf_dir)
    lam = (F.lit(1.5) - (F.col("score_a") + F.lit(1000.0)) / F.lit(11000.0)) / F.lit(365.0)
    base = base.withColumn("curve", sc.cumulative_curve(sc.exp_curve(lam, _CURVE_BREAKS)))
    out = sv.calibration_curves(base, pred_curve="curve", time="time", event="event", bin_on="pred_median",
                                grid=[float(b) for b in _CURVE_BREAKS[1:]], g=4)
    return out.select("bin", F.col("k").cast("bigint").alias("k"), "at", r("predicted", 6).alias("predicted"),
                      r("observed", 6).alias("observed"))

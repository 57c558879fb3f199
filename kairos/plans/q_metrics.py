"""Contract queries: classification metrics and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairos.functions import bins
from kairos.functions.stats import pearson_test
from kairos.operators import metrics as mt
from kairos.operators import survival as sv
from kairos.plans.q_survival import SV_SQL, _BREAKS, _bin_sql, km_sql, surv_base
from kairos.plans.registry import query, r

# Evaluable at the horizon: dead, or followed longer than the horizon (S8, strict '>').
# The fixture follows patients for years (median survival ~2,100 days), so the
# queries use the 5-year horizon of the reference; at 365 days almost nobody dies.
HORIZON = 1825
EV_SQL = f"""
select patient_id, site, cluster_id, score_a, cast(n_visits as double) as n_visits, time, event,
  (event and time <= {HORIZON}) as died_1y from sv where event or time > {HORIZON}
"""


def evaluable(spark, sf_dir, horizon: int = HORIZON):
    """K6: evaluable rows at ``horizon`` and the died-by-horizon flag."""
    b = surv_base(spark, sf_dir)
    return (b.filter(F.col("event") | (F.col("time") > horizon))
            .withColumn("died_1y", F.col("event") & (F.col("time") <= horizon))
            .withColumn("n_visits", F.col("n_visits").cast("double")))


_AUC_SQL = """
with c as (select site, score_a as s, sum(case when not died_1y then 1 else 0 end) as pos,
             sum(case when died_1y then 1 else 0 end) as neg from ev group by site, score_a),
w as (select *, coalesce(sum(neg) over (partition by site order by s rows between unbounded preceding and 1 preceding), 0) as lt_neg,
        coalesce(sum(pos) over (partition by site order by s rows between 1 following and unbounded following), 0) as gt_pos,
        sum(pos) over (partition by site) as P, sum(neg) over (partition by site) as N from c),
v as (select *, (lt_neg + 0.5e0 * neg) / N as v10, (gt_pos + 0.5e0 * pos) / P as v01 from w),
a as (select site, max(P) as P, max(N) as N, sum(pos * v10) / max(P) as auc, sum(pos * v10 * v10) as q10,
        sum(neg * v01 * v01) as q01 from v group by site),
x as (select *, (q10 - P * auc * auc) / (P - 1) / P + (q01 - N * auc * auc) / (N - 1) / N as var from a)
select site, cast(P as bigint) as n_pos, cast(N as bigint) as n_neg, round(auc, 6) as auc, round(var, 8) as var,
  round(greatest(auc - 1.959963984540054e0 * sqrt(greatest(var, 0e0)), 0e0), 6) as lower,
  round(least(auc + 1.959963984540054e0 * sqrt(greatest(var, 0e0)), 1e0), 6) as upper
from x
"""


@query("k1_auc_delong", "K1 K2 K6", _AUC_SQL, extra_views={"sv": SV_SQL, "ev": EV_SQL})
def k1_auc_delong(spark, sf_dir):
    ev = evaluable(spark, sf_dir).withColumn("survived", ~F.col("died_1y"))
    a = mt.auc(ev, score="score_a", label="survived", by=["site"])
    return a.select("site", "n_pos", "n_neg", r("auc", 6).alias("auc"), r("var", 8).alias("var"),
                    r("lower", 6).alias("lower"), r("upper", 6).alias("upper"))


@query("k3_clustered_auc", "K3", """
with lab as (select *, not died_1y as y from ev),
sa as (select 'score_a' as sc, score_a as s, y, cluster_id from lab union all
       select 'n_visits', n_visits, y, cluster_id from lab),
c as (select sc, s, sum(case when y then 1 else 0 end) as pos, sum(case when y then 0 else 1 end) as neg from sa group by sc, s),
w as (select *, coalesce(sum(neg) over (partition by sc order by s rows between unbounded preceding and 1 preceding), 0) as lt_neg,
        coalesce(sum(pos) over (partition by sc order by s rows between 1 following and unbounded following), 0) as gt_pos,
        sum(pos) over (partition by sc) as P, sum(neg) over (partition by sc) as N from c),
pl as (select sc, s, (lt_neg + 0.5e0 * neg) / N as p10, (gt_pos + 0.5e0 * pos) / P as p01 from w),
per as (select sa.sc, sa.cluster_id, sum(case when sa.y then p10 else 0e0 end) as v10,
          sum(case when not sa.y then p01 else 0e0 end) as v01,
          sum(case when sa.y then 1 else 0 end) as m, sum(case when sa.y then 0 else 1 end) as n
        from sa join pl on pl.sc = sa.sc and pl.s = sa.s group by sa.sc, sa.cluster_id),
tot as (select sc, sum(m) as mtot, sum(n) as ntot, sum(v10) / sum(m) as auc, sum(case when m > 0 then 1 else 0 end) as i10,
          sum(case when n > 0 then 1 else 0 end) as i01, count(*) as icl from per group by sc),
d as (select per.cluster_id, per.sc, tot.auc, per.v10 - per.m * tot.auc as d10, per.v01 - per.n * tot.auc as d01,
        tot.mtot, tot.ntot, tot.i10, tot.i01, tot.icl
      from per join tot on tot.sc = per.sc),
g as (select x.sc as a, y.sc as b, x.auc as auc_a, y.auc as auc_b, x.mtot, x.ntot, x.i10, x.i01, x.icl,
        sum(x.d10 * y.d10) as s10, sum(x.d01 * y.d01) as s01, sum(x.d10 * y.d01) + sum(y.d10 * x.d01) as s11
      from d x join d y on x.cluster_id = y.cluster_id group by x.sc, y.sc, x.auc, y.auc, x.mtot, x.ntot, x.i10, x.i01, x.icl)
select a, b, round(auc_a, 6) as auc_a, round(auc_b, 6) as auc_b,
  round(i10 / ((i10 - 1) * mtot) * s10 / mtot + i01 / ((i01 - 1) * ntot) * s01 / ntot + icl / (icl - 1e0) * s11 / (mtot * ntot), 8) + 0e0 as cov
from g
""", extra_views={"sv": SV_SQL, "ev": EV_SQL})
def k3_clustered_auc(spark, sf_dir):
    ev = evaluable(spark, sf_dir).withColumn("y", ~F.col("died_1y"))
    c = mt.clustered_auc(ev, scores=["score_a", "n_visits"], label="y", cluster="cluster_id")
    return c.select("a", "b", r("auc_a", 6).alias("auc_a"), r("auc_b", 6).alias("auc_b"), r("cov", 8).alias("cov"))


@query("k5_roc", "K5", """
with c as (select score_a as s, sum(case when died_1y then 0 else 1 end) as pos, sum(case when died_1y then 1 else 0 end) as neg
           from ev group by score_a),
w as (select s, sum(pos) over (order by s desc rows between unbounded preceding and current row) as tp,
        sum(neg) over (order by s desc rows between unbounded preceding and current row) as fp,
        sum(pos) over () as P, sum(neg) over () as N from c)
select s as threshold, round(tp / P, 6) as tpr, round(fp / N, 6) as fpr from w
""", extra_views={"sv": SV_SQL, "ev": EV_SQL})
def k5_roc(spark, sf_dir):
    ev = evaluable(spark, sf_dir).withColumn("y", ~F.col("died_1y"))
    roc = mt.roc_points(ev, score="score_a", label="y")
    return roc.select("threshold", r("tpr", 6).alias("tpr"), r("fpr", 6).alias("fpr"))


@query("k7_threshold", "K7 K6", """
with a as (select count(*) filter (where score_a < 0 and died_1y) as tp, count(*) filter (where score_a < 0 and not died_1y) as fp,
             count(*) filter (where not (score_a < 0) and died_1y) as fn, count(*) filter (where not (score_a < 0) and not died_1y) as tn
           from ev)
select cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, cast(tn as bigint) as tn,
  round(tp / (tp + fp), 6) as ppv, round(tn / (tn + fn), 6) as npv, round(tp / (tp + fn), 6) as sensitivity,
  round(tn / (tn + fp), 6) as specificity, round((tp / (tp + fn)) / (1 - tn / (tn + fp)), 6) as lr_pos,
  round((1 - tp / (tp + fn)) / (tn / (tn + fp)), 6) as lr_neg, round((tp * tn * 1e0) / (fp * fn), 6) as dor,
  round(((tp + fp) * 1e0 * (fn + tn) * (tp / (tp + fp) + tn / (tn + fn) - 1)) / ((tp + fn) * 1e0 * (fp + tn)), 6) as gini
from a
""", extra_views={"sv": SV_SQL, "ev": EV_SQL})
def k7_threshold(spark, sf_dir):
    ev = evaluable(spark, sf_dir)
    t = mt.threshold_metrics(ev, flag=F.col("score_a") < 0, outcome=F.col("died_1y"))
    return t.select("tp", "fp", "fn", "tn", *[r(c, 6).alias(c) for c in
                                             ("ppv", "npv", "sensitivity", "specificity", "lr_pos", "lr_neg", "dor", "gini")])


@query("k8_matched_cut", "K8", """
with k as (select count(*) as k from ev where n_visits >= 12),
sorted as (select list(-score_a order by -score_a) as risk from ev),
t as (select k, risk[len(risk) - k] as threshold from sorted, k)
select cast(k as bigint) as k, threshold,
  cast((select count(*) from ev where t.threshold is null or -score_a > t.threshold) as bigint) as n_flagged
from t
""", extra_views={"sv": SV_SQL, "ev": EV_SQL})
def k8_matched_cut(spark, sf_dir):
    ev = evaluable(spark, sf_dir).withColumn("risk", -F.col("score_a"))
    return mt.matched_threshold(ev, score="risk", k=ev.agg(F.count_if(F.col("n_visits") >= 12)))


@query("k9_summary", "K9", """
select site, cast(count(time) as bigint) as n, cast(min(time) as double) as min, quantile_cont(time, 0.25) as q1,
  quantile_cont(time, 0.5) as median, round(avg(time), 6) as mean, quantile_cont(time, 0.75) as q3, cast(max(time) as double) as max
from sv group by site
""", extra_views={"sv": SV_SQL})
def k9_summary(spark, sf_dir):
    s = mt.summary(surv_base(spark, sf_dir), "time", by=["site"])
    return s.select("site", "n", *[F.col(c).cast("double").alias(c) for c in ("min", "q1", "median")],
                    r("mean", 6).alias("mean"), *[F.col(c).cast("double").alias(c) for c in ("q3", "max")])


@query("k9_shares", "K9", """
select site, cast(count(*) as bigint) as n, round(count(*) / sum(count(*)) over (), 6) as share from patients group by site
""")
def k9_shares(spark, sf_dir):
    from kairos.sources import fixtures as fx
    s = mt.category_shares(fx.patients(spark, sf_dir), "site")
    return s.select("site", "n", r("share", 6).alias("share"))


@query("k10_crosstab", "K10", """
with c as (select site, cluster_id, count(*) as n from patients group by site, cluster_id),
g as (select s.site, k.cluster_id from (select distinct site from patients) s, (select distinct cluster_id from patients) k),
f as (select g.site, g.cluster_id, coalesce(c.n, 0) as n from g left join c on c.site = g.site and c.cluster_id = g.cluster_id)
select site, cluster_id, cast(n as bigint) as n, round(n / sum(n) over (partition by site), 6) as row_share from f
""")
def k10_crosstab(spark, sf_dir):
    from kairos.sources import fixtures as fx
    ct = mt.crosstab(fx.patients(spark, sf_dir), "site", "cluster_id")
    return ct.select("site", "cluster_id", F.col("n").cast("long"), r("row_share", 6).alias("row_share"))


@query("k11_chi2", "K11", """
with c as (select site, dead, count(*) as n from patients group by site, dead),
r as (select site, sum(n) as rt from c group by site), k as (select dead, sum(n) as ct from c group by dead),
t as (select sum(n) as tot from c)
select round(sum(pow(c.n - r.rt * k.ct / t.tot, 2) / (r.rt * k.ct / t.tot)), 6) as chisq,
  cast((count(distinct c.site) - 1) * (count(distinct c.dead) - 1) as bigint) as df,
  round(exp(-sum(pow(c.n - r.rt * k.ct / t.tot, 2) / (r.rt * k.ct / t.tot)) / 2)
        * (1 + sum(pow(c.n - r.rt * k.ct / t.tot, 2) / (r.rt * k.ct / t.tot)) / 2), 6) as p
from c join r on r.site = c.site join k on k.dead = c.dead, t
""")
def k11_chi2(spark, sf_dir):
    from kairos.sources import fixtures as fx
    c = mt.chi_square(fx.patients(spark, sf_dir), "site", "dead")
    # four degrees of freedom (five sites, two outcomes): the oracle has the closed form of the tail
    return c.select(r("chisq", 6).alias("chisq"), F.col("df").cast("long"), r(mt.chi2_tail("chisq", "df"), 6).alias("p"))


@query("k12_corr", "K12", """
with c as (select corr(score_a, n_visits) as r, count(*) as n from sv),
a as (select n - 2 as df, atan(abs(r) * sqrt((n - 2) / (1 - r * r)) / sqrt(n - 2)) as th from c),
-- Student's t for whole degrees of freedom: A(t) = sin(th) * sum c_j cos(th)^2j, or 2/pi (th + sin(th) cos(th) sum d_j cos(th)^2j)
j as (select unnest(range(cast((select df // 2 from a) as bigint))) as j),
w as (select j, exp(sum(case when j = 0 then 0e0 when a.df % 2 = 0 then ln((2 * j - 1e0) / (2 * j)) else ln(2e0 * j / (2 * j + 1)) end) over (order by j)) as c,
        a.df, a.th from j, a),
t as (select case when max(df) % 2 = 0 then sin(max(th)) * sum(c * pow(cos(th), 2 * j))
             else 2 / pi() * (max(th) + sin(max(th)) * cos(max(th)) * sum(c * pow(cos(th), 2 * j))) end as inside from w)
select (select round(1 - inside, 6) + 0e0 from t) as p, round(corr(score_a, n_visits), 6) + 0e0 as r, cast(count(*) as bigint) as n,
  round(corr(score_a, n_visits) * sqrt((count(*) - 2) / (1 - pow(corr(score_a, n_visits), 2))), 6) + 0e0 as t,
  round(tanh(atanh(corr(score_a, n_visits)) - 1.959963984540054e0 / sqrt(count(*) - 3)), 6) + 0e0 as lower,
  round(tanh(atanh(corr(score_a, n_visits)) + 1.959963984540054e0 / sqrt(count(*) - 3)), 6) + 0e0 as upper
from sv
""", extra_views={"sv": SV_SQL})
def k12_corr(spark, sf_dir):
    c = mt.correlation(surv_base(spark, sf_dir).withColumn("n_visits", F.col("n_visits").cast("double")),
                       "score_a", "n_visits")
    one = c.first()  # one row: the tail of Student's t is taken on the driver
    p = pearson_test(one["r"], one["n"])["p"]
    return c.select(F.lit(round(p, 6) + 0.0).alias("p"), r("r", 6).alias("r"), "n", r("t", 6).alias("t"), r("lower", 6).alias("lower"), r("upper", 6).alias("upper"))


@query("k13_weighted", "K13", """
select site, round(sum(n_visits * score_a) / sum(n_visits), 6) as weighted_mean from sv group by site
""", extra_views={"sv": SV_SQL})
def k13_weighted(spark, sf_dir):
    w = mt.weighted_mean(surv_base(spark, sf_dir), "score_a", "n_visits", by=["site"])
    return w.select("site", r("weighted_mean", 6).alias("weighted_mean"))


@query("k13_group_sizes", "K13 K17", """
select cluster_id, cast(count(*) as bigint) as n,
  cast(row_number() over (order by count(*) desc, cluster_id) as bigint) as size_rank
from patients group by cluster_id
""")
def k13_group_sizes(spark, sf_dir):
    from kairos.sources import fixtures as fx
    g = mt.group_sizes(fx.patients(spark, sf_dir), "cluster_id")
    return g.select("cluster_id", "n", F.col("size_rank").cast("long"))


@query("k14_cindex_by_group", "K14 J5", """
with pa as (select a.cluster_id,
             case when a.score_a < b.score_a then 1e0 when a.score_a > b.score_a then 0e0 else 0.5e0 end as ca,
             case when a.n_visits < b.n_visits then 1e0 when a.n_visits > b.n_visits then 0e0 else 0.5e0 end as cb
           from sv a join sv b on a.cluster_id = b.cluster_id and a.event
             and (a.time < b.time or (a.time = b.time and not b.event)))
select pa.cluster_id, cast(count(*) as bigint) as comparable, round(avg(ca), 6) as cindex_a, round(avg(cb), 6) as cindex_b,
  round(avg(ca) - avg(cb), 6) + 0e0 as diff, max(c.n) as n, round(max(c.mean_score), 4) + 0e0 as mean_score
from pa join (select cluster_id, cast(count(*) as bigint) as n, avg(score_a) as mean_score from sv group by cluster_id) c
  on c.cluster_id = pa.cluster_id
group by pa.cluster_id
""", extra_views={"sv": SV_SQL})
def k14_cindex_by_group(spark, sf_dir):
    b = surv_base(spark, sf_dir)
    a = sv.cindex(b, score="score_a", by=["cluster_id"]).select("cluster_id", "comparable",
                                                                  F.col("cindex").alias("cindex_a"))
    c = sv.cindex(b, score="n_visits", by=["cluster_id"]).select("cluster_id", F.col("cindex").alias("cindex_b"))
    size = b.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score_a").alias("mean_score"))  # covariate and size
    j = a.join(c, "cluster_id").join(size, "cluster_id")
    return j.select("cluster_id", "n", r("mean_score", 4).alias("mean_score"), "comparable", r("cindex_a", 6).alias("cindex_a"), r("cindex_b", 6).alias("cindex_b"),
                    r(F.col("cindex_a") - F.col("cindex_b"), 6).alias("diff"))


@query("k16_discrepancy", "K16 B22", f"""
select patient_id, site, {_bin_sql('time')} as bin_actual, {_bin_sql('pred_median')} as bin_pred
from sv where abs({_bin_sql('pred_median')} - {_bin_sql('time')}) >= 5
""", extra_views={"sv": SV_SQL})
def k16_discrepancy(spark, sf_dir):
    b = surv_base(spark, sf_dir).select("patient_id", "site", bins.cut("time", _BREAKS).alias("bin_actual"),
                                        bins.cut("pred_median", _BREAKS).alias("bin_pred"))
    from kairos.operators.rows import disagreement
    return disagreement(b, "bin_pred", "bin_actual", 5).orderBy(F.col("bin_pred").desc(), "bin_actual", "patient_id")


@query("k17_distinct", "K17", """
select visit_type, cast(count(distinct patient_id) as bigint) as n_distinct, cast(count(*) as bigint) as n_rows,
  round(count(*) / count(distinct patient_id), 6) as rows_per_entity from visits group by visit_type
""")
def k17_distinct(spark, sf_dir):
    from kairos.sources import fixtures as fx
    d = mt.distinct_counts(fx.visits(spark, sf_dir), "patient_id", by=["visit_type"])
    return d.select("visit_type", "n_distinct", "n_rows", r("rows_per_entity", 6).alias("rows_per_entity"))


_RECLASS_SQL = f"""
select time, event, {_bin_sql('pred_median')} as bin_a,
  case when {_bin_sql('n_visits * 60e0')} < {_bin_sql('pred_median')} then 'Shorter'
       when {_bin_sql('n_visits * 60e0')} = {_bin_sql('pred_median')} then 'Same' else 'Longer' end as relation
from sv
"""


@query("k18_reclass", "K18 J1 J2", """
with b as (select bin_a, relation, max(time) as t0 from km where time <= 365 group by bin_a, relation),
n as (select bin_a, relation, cast(count(*) as bigint) as n, cast(sum(case when event then 1 else 0 end) as bigint) as events
      from rc group by bin_a, relation)
select n.bin_a, n.relation, n.n, n.events, round(coalesce(k.surv, 1e0), 6) as surv_365
from n left join b on b.bin_a = n.bin_a and b.relation = n.relation
left join km k on k.bin_a = b.bin_a and k.relation = b.relation and k.time = b.t0
""", extra_views={"sv": SV_SQL, "rc": _RECLASS_SQL, "km": km_sql("rc", ["bin_a", "relation"])})
def k18_reclass(spark, sf_dir):
    b = surv_base(spark, sf_dir)
    a = bins.cut("pred_median", _BREAKS)
    bb = bins.cut(F.col("n_visits") * 60.0, _BREAKS)
    rc = b.select("time", "event", a.alias("bin_a"),
                  F.when(bb < a, "Shorter").when(bb == a, "Same").otherwise("Longer").alias("relation"))
    st = ["bin_a", "relation"]
    km = sv.km_table(rc, strata=st)
    at = sv.surv_at(km, [365.0], strata=st, cols=("surv",))
    n = rc.groupBy(*st).agg(F.count(F.lit(1)).alias("n"), F.count_if("event").alias("events"))
    return n.join(at, st, "left").select(*st, "n", "events", r(F.coalesce("surv", F.lit(1.0)), 6).alias("surv_365"))


@query("k4_auc_table", "K4 K1 K2 B23", """
with long as (select site, died_1y, 'score_a' as method, score_a as s from ev union all
              select site, died_1y, 'n_visits', n_visits from ev),
c as (select site, method, s, sum(case when not died_1y then 1 else 0 end) as pos,
        sum(case when died_1y then 1 else 0 end) as neg from long group by site, method, s),
w as (select *, coalesce(sum(neg) over (partition by site, method order by s rows between unbounded preceding and 1 preceding), 0) as lt_neg,
        coalesce(sum(pos) over (partition by site, method order by s rows between 1 following and unbounded following), 0) as gt_pos,
        sum(pos) over (partition by site, method) as P, sum(neg) over (partition by site, method) as N from c),
v as (select *, (lt_neg + 0.5e0 * neg) / N as v10, (gt_pos + 0.5e0 * pos) / P as v01 from w),
a as (select site, method, max(P) as P, max(N) as N, sum(pos * v10) / max(P) as auc, sum(pos * v10 * v10) as q10,
        sum(neg * v01 * v01) as q01 from v group by site, method),
x as (select *, (q10 - P * auc * auc) / (P - 1) / P + (q01 - N * auc * auc) / (N - 1) / N as var from a)
select site, method, cast(P as bigint) as n_pos, cast(N as bigint) as n_neg,
  printf('%.3f (%.3f-%.3f)', auc, greatest(auc - 1.959963984540054e0 * sqrt(greatest(var, 0e0)), 0e0),
         least(auc + 1.959963984540054e0 * sqrt(greatest(var, 0e0)), 1e0)) as auc_ci
from x
""", extra_views={"sv": SV_SQL, "ev": EV_SQL})
def k4_auc_table(spark, sf_dir):
    ev = evaluable(spark, sf_dir).withColumn("survived", ~F.col("died_1y"))
    return mt.auc_table(ev, scores=["score_a", "n_visits"], label="survived", subgroup="site")


@query("k3_auc_comparison", "K3", """
with lab as (select *, not died_1y as y from ev),
sa as (select 'score_a' as sc, score_a as s, y, cluster_id from lab union all
       select 'n_visits', n_visits, y, cluster_id from lab),
c as (select sc, s, sum(case when y then 1 else 0 end) as pos, sum(case when y then 0 else 1 end) as neg from sa group by sc, s),
w as (select *, coalesce(sum(neg) over (partition by sc order by s rows between unbounded preceding and 1 preceding), 0) as lt_neg,
        coalesce(sum(pos) over (partition by sc order by s rows between 1 following and unbounded following), 0) as gt_pos,
        sum(pos) over (partition by sc) as P, sum(neg) over (partition by sc) as N from c),
pl as (select sc, s, (lt_neg + 0.5e0 * neg) / N as p10, (gt_pos + 0.5e0 * pos) / P as p01 from w),
per as (select sa.sc, sa.cluster_id, sum(case when sa.y then p10 else 0e0 end) as v10,
          sum(case when not sa.y then p01 else 0e0 end) as v01,
          sum(case when sa.y then 1 else 0 end) as m, sum(case when sa.y then 0 else 1 end) as n
        from sa join pl on pl.sc = sa.sc and pl.s = sa.s group by sa.sc, sa.cluster_id),
tot as (select sc, sum(m) as mtot, sum(n) as ntot, sum(v10) / sum(m) as auc, sum(case when m > 0 then 1 else 0 end) as i10,
          sum(case when n > 0 then 1 else 0 end) as i01, count(*) as icl from per group by sc),
d as (select per.cluster_id, per.sc, tot.auc, per.v10 - per.m * tot.auc as d10, per.v01 - per.n * tot.auc as d01,
        tot.mtot, tot.ntot, tot.i10, tot.i01, tot.icl
      from per join tot on tot.sc = per.sc),
g as (select x.sc as a, y.sc as b, x.auc as auc_a, y.auc as auc_b, x.mtot, x.ntot, x.i10, x.i01, x.icl,
        sum(x.d10 * y.d10) as s10, sum(x.d01 * y.d01) as s01, sum(x.d10 * y.d01) + sum(y.d10 * x.d01) as s11
      from d x join d y on x.cluster_id = y.cluster_id group by x.sc, y.sc, x.auc, y.auc, x.mtot, x.ntot, x.i10, x.i01, x.icl),
cv as (select a, b, auc_a, i10 / ((i10 - 1) * mtot) * s10 / mtot + i01 / ((i01 - 1) * ntot) * s01 / ntot
          + icl / (icl - 1e0) * s11 / (mtot * ntot) as cov from g)
select round(v1.auc_a, 6) as auc_1, round(v2.auc_a, 6) as auc_2,
  round((v1.auc_a - v2.auc_a) / sqrt(v1.cov + v2.cov - 2 * c12.cov), 6) + 0e0 as z
from cv v1, cv v2, cv c12
where v1.a = 'score_a' and v1.b = 'score_a' and v2.a = 'n_visits' and v2.b = 'n_visits'
  and c12.a = 'score_a' and c12.b = 'n_visits'
""", extra_views={"sv": SV_SQL, "ev": EV_SQL})
def k3_auc_comparison(spark, sf_dir):
    ev = evaluable(spark, sf_dir).withColumn("y", ~F.col("died_1y"))
    c = mt.clustered_auc(ev, scores=["score_a", "n_visits"], label="y", cluster="cluster_id")
    z = mt.compare_aucs(c, "score_a", "n_visits")
    return z.select(r("auc_1", 6).alias("auc_1"), r("auc_2", 6).alias("auc_2"), r("z", 6).alias("z"))


@query("k3_all_pairs", "K3", """
with lab as (select *, not died_1y as y from ev),
sa as (select 'score_a' as sc, score_a as s, y, cluster_id from lab union all
       select 'n_visits', n_visits, y, cluster_id from lab union all
       select 'combined', score_a / 1000e0 + n_visits, y, cluster_id from lab),
c as (select sc, s, sum(case when y then 1 else 0 end) as pos, sum(case when y then 0 else 1 end) as neg from sa group by sc, s),
w as (select *, coalesce(sum(neg) over (partition by sc order by s rows between unbounded preceding and 1 preceding), 0) as lt_neg,
        coalesce(sum(pos) over (partition by sc order by s rows between 1 following and unbounded following), 0) as gt_pos,
        sum(pos) over (partition by sc) as P, sum(neg) over (partition by sc) as N from c),
pl as (select sc, s, (lt_neg + 0.5e0 * neg) / N as p10, (gt_pos + 0.5e0 * pos) / P as p01 from w),
per as (select sa.sc, sa.cluster_id, sum(case when sa.y then p10 else 0e0 end) as v10,
          sum(case when not sa.y then p01 else 0e0 end) as v01,
          sum(case when sa.y then 1 else 0 end) as m, sum(case when sa.y then 0 else 1 end) as n
        from sa join pl on pl.sc = sa.sc and pl.s = sa.s group by sa.sc, sa.cluster_id),
tot as (select sc, sum(m) as mtot, sum(n) as ntot, sum(v10) / sum(m) as auc, sum(case when m > 0 then 1 else 0 end) as i10,
          sum(case when n > 0 then 1 else 0 end) as i01, count(*) as icl from per group by sc),
d as (select per.cluster_id, per.sc, tot.auc, per.v10 - per.m * tot.auc as d10, per.v01 - per.n * tot.auc as d01,
        tot.mtot, tot.ntot, tot.i10, tot.i01, tot.icl
      from per join tot on tot.sc = per.sc),
g as (select x.sc as a, y.sc as b, x.auc as auc_a, y.auc as auc_b, x.mtot, x.ntot, x.i10, x.i01, x.icl,
        sum(x.d10 * y.d10) as s10, sum(x.d01 * y.d01) as s01, sum(x.d10 * y.d01) + sum(y.d10 * x.d01) as s11
      from d x join d y on x.cluster_id = y.cluster_id group by x.sc, y.sc, x.auc, y.auc, x.mtot, x.ntot, x.i10, x.i01, x.icl),
cv as (select a, b, auc_a, i10 / ((i10 - 1) * mtot) * s10 / mtot + i01 / ((i01 - 1) * ntot) * s01 / ntot
          + icl / (icl - 1e0) * s11 / (mtot * ntot) as cov from g),
z as (select v1.a as method_1, v2.a as method_2, v1.auc_a as auc_1, v2.auc_a as auc_2,
        (v1.auc_a - v2.auc_a) / sqrt(v1.cov + v2.cov - 2 * c12.cov) as z
      from cv v1, cv v2, cv c12 where v1.a = v1.b and v2.a = v2.b and c12.a = v1.a and c12.b = v2.a and v1.a < v2.a),
-- the two-sided tail of the normal distribution: 1 - erf by its series, and erfc by its asymptotic one where that would cancel
e as (select z.*, j, abs(z) / sqrt(2e0) as x from z, (select unnest(range(150)) as j)),
p as (select method_1, method_2, 1 - 2 / sqrt(pi()) * sum(pow(-1, j) * exp((2 * j + 1) * ln(greatest(x, 1e-300)) - lgamma(j + 1e0)) / (2 * j + 1)) as p
      from e where x < 3e0 group by method_1, method_2)
select z.method_1, z.method_2, round(auc_1, 6) as auc_1, round(auc_2, 6) as auc_2, round(z, 6) + 0e0 as z, round(coalesce(p.p, exp(-z.z * z.z / 2e0) / (abs(z.z) * sqrt(pi() / 2e0)) * (1 - 1 / pow(z.z, 2) + 3 / pow(z.z, 4) - 15 / pow(z.z, 6))), 6) + 0e0 as p
from z left join p on p.method_1 = z.method_1 and p.method_2 = z.method_2
""", extra_views={"sv": SV_SQL, "ev": EV_SQL})
def k3_all_pairs(spark, sf_dir):
    """Every pair of three scores compared, with cluster-robust variances and two-sided p values."""
    ev = evaluable(spark, sf_dir).withColumn("y", ~F.col("died_1y")).withColumn("combined", F.col("score_a") / F.lit(1000.0) + F.col("n_visits"))
    c = mt.clustered_auc(ev, scores=["score_a", "n_visits", "combined"], label="y", cluster="cluster_id")
    rows = [(t["a"], t["b"], *(round(t[k], 6) + 0.0 for k in ("auc_1", "auc_2", "z", "p"))) for t in mt.compare_all_aucs(c)]
    return spark.createDataFrame(rows, "method_1 string, method_2 string, auc_1 double, auc_2 double, z double, p double")


_RELATION_SQL = f"""
select time, event, a_group, case when b <= (case a_group when 1 then -1 when 2 then 2 when 3 then 4 else 6 end) then 'Shorter'
    when b <= (case a_group when 1 then 2 when 2 then 4 when 3 then 6 else 999 end) then 'Same' else 'Longer' end as relation
from (select time, event, cast((least(a, 7) + 1) // 2 as int) as a_group, b
      from (select time, event, {_bin_sql('pred_median')} as a, {_bin_sql('n_visits * 60e0')} as b from sv))
"""


@query("k18_logrank", "K18 J4", """
with gr as (select distinct a_group, relation from rel),
t as (select a_group, time, count(*) filter (event) * 1e0 as d from rel group by a_group, time having count(*) filter (event) > 0),
g as (select t.a_group, t.time, t.d, gr.relation,
        (select count(*) from rel x where x.a_group = t.a_group and x.relation = gr.relation and x.time >= t.time) as n_g,
        (select count(*) from rel x where x.a_group = t.a_group and x.relation = gr.relation and x.time = t.time and x.event) as d_g
      from t join gr on gr.a_group = t.a_group),
n as (select *, sum(n_g) over (partition by a_group, time) as n from g),
oe as (select a_group, relation, sum(d_g) - sum(n_g * d / n) as oe, row_number() over (partition by a_group order by relation) as i
       from n group by a_group, relation),
vv as (select x.a_group, x.relation as r1, y.relation as r2,
         sum(case when x.n > 1 then x.d * (x.n - x.d) / (x.n - 1) else 0e0 end * x.n_g / x.n
             * (case when x.relation = y.relation then 1e0 else 0e0 end - y.n_g / y.n)) as v
       from n x join n y on x.a_group = y.a_group and x.time = y.time group by x.a_group, x.relation, y.relation),
s as (select a.a_group, a.oe as d1, b.oe as d2, v1.v as v11, v2.v as v22, v12.v as v12, k
      from (select *, max(i) over (partition by a_group) as k from oe) a
      join vv v1 on v1.a_group = a.a_group and v1.r1 = a.relation and v1.r2 = a.relation
      left join oe b on b.a_group = a.a_group and b.i = 2 and a.k = 3
      left join vv v2 on v2.a_group = b.a_group and v2.r1 = b.relation and v2.r2 = b.relation
      left join vv v12 on v12.a_group = a.a_group and v12.r1 = a.relation and v12.r2 = b.relation
      where a.i = 1)
select a_group, cast(k - 1 as int) as df,
  round(case when k = 2 then d1 * d1 / v11 else (d1 * d1 * v22 - 2 * d1 * d2 * v12 + d2 * d2 * v11) / (v11 * v22 - v12 * v12) end, 4) as chisq,
  case when k = 3 then round(exp(-(d1 * d1 * v22 - 2 * d1 * d2 * v12 + d2 * d2 * v11) / (v11 * v22 - v12 * v12) / 2), 4) end as p_two_df
from s where k > 1
""", extra_views={"sv": SV_SQL, "rel": _RELATION_SQL})
def k18_logrank(spark, sf_dir):
    """Log-rank of the relation (B shorter, same, longer) within the merged A groups {1,2}, {3,4}, {5,6}, {7}.

    ``p_two_df`` is the p value where the test has two degrees of freedom (SQL has no tail for one); ``logrank_tests``
    returns it for any.
    """
    b = surv_base(spark, sf_dir)
    a, bb = bins.cut("pred_median", _BREAKS), bins.cut(F.col("n_visits") * 60.0, _BREAKS)
    group = F.floor((F.least(a, F.lit(7)) + 1) / 2).cast("int")
    rel = b.select("time", "event", group.alias("a_group"), bb.alias("_b"))
    low = F.element_at(F.array(*[F.lit(x) for x in (-1, 2, 4, 6)]), F.col("a_group"))
    high = F.element_at(F.array(*[F.lit(x) for x in (2, 4, 6, 999)]), F.col("a_group"))
    rel = rel.select("time", "event", "a_group", F.when(F.col("_b") <= low, "Shorter").when(F.col("_b") <= high, "Same")
                     .otherwise("Longer").alias("relation"))
    rows = [(int(t["stratum"]), int(t["df"]), round(float(t["chisq"]), 4), round(float(t["p"]), 4) if t["df"] == 2 else None)
            for t in sv.logrank_tests(rel, by="a_group", group="relation") if t["df"] > 0]
    return spark.createDataFrame(rows, "a_group int, df int, chisq double, p_two_df double")

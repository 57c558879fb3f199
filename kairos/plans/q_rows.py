"""Contract queries: projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairos.functions import bins, dates
from kairos.operators import dedup, rows
from kairos.plans.registry import query, r
from kairos.sources import fixtures as fx

# Prognosis bins in days (right-closed, lowest included).
PROGNOSIS_BREAKS = [365 * x for x in (-1, 0.25, 0.5, 0.75, 1, 1.5, 2, 999999)]

_FU_SQL = "greatest(datediff('day', earliest_mets, death_date), datediff('day', earliest_mets, lfu_date))"


def _fu():
    return dates.follow_up_days("death_date", "lfu_date", "earliest_mets")


@query("b_followup", "B1 B2 B3 B6 B8 B9 B10 E6", f"""
select patient_id, cast({_FU_SQL} as int) as fu_days, dead,
  round(datediff('day', dob, earliest_mets) / 365e0, 4) as age_dx,
  coalesce(death_date, lfu_date) as last_date,
  nullif(site, 'MACHINERY') as site_clean
from patients
where lfu_date is not null and {_FU_SQL} > 0 and datediff('day', dob, earliest_mets) / 365e0 >= 18
""")
def b_followup(spark, sf_dir):
    p = rows.not_null(fx.patients(spark, sf_dir), "lfu_date")
    age = dates.age_years("earliest_mets", "dob")
    p = p.select("patient_id", _fu().cast("int").alias("fu_days"), "dead", age.alias("_age"),
                 F.coalesce("death_date", "lfu_date").alias("last_date"),
                 rows.sentinel_to_null("site", "MACHINERY").alias("site_clean"))
    p = p.filter((F.col("fu_days") > 0) & (F.col("_age") >= 18))
    return p.select("patient_id", "fu_days", "dead", r("_age").alias("age_dx"), "last_date", "site_clean")


@query("b_parse_dates", "B4 B5 B7", """
select event_id,
  cast(strptime(strftime(ts, '%-m/%-d/%Y'), '%m/%d/%Y') as date) as d_parsed,
  date_trunc('day', ts) as day_floor,
  cast(trunc((epoch_us(ts) - epoch_us(timestamp '2000-01-01')) / 86400e6) as int) as date_int,
  strptime(substr(cast(ts as varchar), 1, 16), '%Y-%m-%d %H:%M') as ts16
from events
""")
def b_parse_dates(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_id", "ts")
    return e.select(
        "event_id",
        dates.parse_date(F.date_format("ts", "M/d/yyyy"), "M/d/yyyy").alias("d_parsed"),
        dates.floor_day("ts").alias("day_floor"),
        dates.day_number("ts").cast("int").alias("date_int"),
        dates.parse_timestamp(F.col("ts").cast("string")).alias("ts16"))


@query("b_labels", "B12 B17 B18", f"""
select patient_id, least({_FU_SQL}, 1825) as fu_time,
  case when {_FU_SQL} > 1825 then false else dead end as event,
  (not dead) or {_FU_SQL} > 365 as surv_12mo,
  dead or {_FU_SQL} > 365 as include_surv_12mo,
  round(1e0 - (score_a + 1000e0) / 11000e0, 6) as risk,
  -score_a as neg_score
from patients
""")
def b_labels(spark, sf_dir):
    p = fx.patients(spark, sf_dir).withColumn("_t", _fu())
    surv = (F.col("score_a") + F.lit(1000.0)) / F.lit(11000.0)
    return p.select(
        "patient_id", dates.censor_time("_t", 1825).alias("fu_time"),
        dates.censor_event("dead", "_t", 1825).alias("event"),
        (~F.col("dead") | (F.col("_t") > 365)).alias("surv_12mo"),
        (F.col("dead") | (F.col("_t") > 365)).alias("include_surv_12mo"),
        r(F.lit(1.0) - surv, 6).alias("risk"), (-F.col("score_a")).alias("neg_score"))


@query("b_recode", "B13", """
select patient_id,
  case when site in ('AUTOMOBILE', 'MACHINERY') then 'industry'
       when site in ('HOUSEHOLD', 'FURNITURE') then 'home' else 'other' end as site_group,
  (cluster_id in (3, 7, 11) or cluster_id + 1 in (3, 7, 11) or cluster_id + 2 in (3, 7, 11)) as in_group
from patients
""")
def b_recode(spark, sf_dir):
    p = fx.patients(spark, sf_dir)
    grp = bins.recode("site", {"industry": ["AUTOMOBILE", "MACHINERY"], "home": ["HOUSEHOLD", "FURNITURE"]},
                      default="other")
    member = bins.any_in([F.col("cluster_id"), F.col("cluster_id") + 1, F.col("cluster_id") + 2], [3, 7, 11])
    return p.select("patient_id", grp.alias("site_group"), member.alias("in_group"))


def _bin_sql(x: str) -> str:
    b = PROGNOSIS_BREAKS
    parts = [f"when {x} >= {b[0]}e0 and {x} <= {b[1]}e0 then 1"]
    for i in range(1, len(b) - 1):
        parts.append(f"when {x} > {b[i]}e0 and {x} <= {b[i + 1]}e0 then {i + 1}")
    return "case " + " ".join(parts) + " end"


_PRED_SQL = "((score_a + 1000e0) * 0.4e0)"


def _binned(spark, sf_dir):
    p = fx.patients(spark, sf_dir).withColumn("_t", _fu())
    pred = (F.col("score_a") + F.lit(1000.0)) * F.lit(0.4)
    return p.select("patient_id", bins.cut("_t", PROGNOSIS_BREAKS).alias("bin_actual"),
                    bins.cut(pred, PROGNOSIS_BREAKS).alias("bin_pred"))


@query("b_bins", "B14 B16", f"""
select patient_id, {_bin_sql(_FU_SQL)} as bin_actual, {_bin_sql(_PRED_SQL)} as bin_pred,
  cast(ceil(({_bin_sql(_FU_SQL)} + {_bin_sql(_PRED_SQL)}) / 2e0 - 0.5e0) as int) as bin_mean
from patients
""")
def b_bins(spark, sf_dir):
    b = _binned(spark, sf_dir)
    return b.withColumn("bin_mean", bins.mean_round_half_down("bin_actual", "bin_pred"))


@query("b_disagreement", "B22", f"""
select patient_id, {_bin_sql(_FU_SQL)} as bin_actual, {_bin_sql(_PRED_SQL)} as bin_pred from patients
where abs({_bin_sql(_PRED_SQL)} - {_bin_sql(_FU_SQL)}) >= 5
""")
def b_disagreement(spark, sf_dir):
    return rows.disagreement(_binned(spark, sf_dir), "bin_pred", "bin_actual", 5)


@query("b_quantile_bins", "B15", """
with c as (select site, score_a, count(*) as n from patients where score_a is not null group by site, score_a),
cum as (select site, score_a, sum(n) over (partition by site order by score_a rows between unbounded preceding and current row) as cum,
        sum(n) over (partition by site) as tot from c),
cuts as (select site, k, min(score_a) as cut from cum, (select unnest([1, 2, 3]) as k) ks
         where cum * 4 >= k * tot group by site, k)
select p.patient_id, p.site,
  cast(1 + (select count(distinct cut) from cuts where cuts.site = p.site and cuts.cut <= p.score_a) as int) as qbin
from patients p
""")
def b_quantile_bins(spark, sf_dir):
    p = fx.patients(spark, sf_dir).select("patient_id", "site", "score_a")
    return rows.quantile_bin(p, "score_a", 4, by=["site"]).select("patient_id", "site", "qbin")


@query("b_quantile_type7", "B15", """
with q as (select site, quantile_cont(score_a, [0.25, 0.5, 0.75]) as cuts from patients group by site)
select p.patient_id, cast(1 + len(list_filter(q.cuts, lambda c: c < p.score_a)) as int) as qbin
from patients p join q on q.site = p.site
""")
def b_quantile_type7(spark, sf_dir):
    p = fx.patients(spark, sf_dir).select("patient_id", "site", "score_a")
    return rows.quantile_bin_type7(p, "score_a", [0.25, 0.5, 0.75], by=["site"]).select("patient_id", "qbin")


@query("b_strings", "B19", """
select patient_id, item_date, substr(feature_name, 1, 4) as kind,
  regexp_replace(feature_name, '^[^_]*_', '') as code,
  split_part(regexp_replace(feature_name, '^[^_]*_', ''), ' ', 1) as first_word,
  regexp_replace(concat(feature_name, ', other'), ',.*', '') as first_entry,
  concat('x_', feature_name) as prefixed
from items
""")
def b_strings(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    code = F.regexp_replace("feature_name", "^[^_]*_", "")
    return it.select("patient_id", "item_date", F.substring("feature_name", 1, 4).alias("kind"), code.alias("code"),
                     F.substring_index(code, " ", 1).alias("first_word"),
                     F.regexp_replace(F.concat("feature_name", F.lit(", other")), ",.*", "").alias("first_entry"),
                     F.concat(F.lit("x_"), "feature_name").alias("prefixed"))


@query("b_membership", "B21", """
select v.visit_id, v.patient_id from visits v
where v.visit_type in ('1-URGENT', '2-HIGH') and v.patient_id in (select patient_id from patients where dead)
""")
def b_membership(spark, sf_dir):
    v = fx.visits(spark, sf_dir).filter(F.col("visit_type").isin("1-URGENT", "2-HIGH"))
    dead = fx.patients(spark, sf_dir).filter("dead").select("patient_id")
    return v.join(dead, "patient_id", "left_semi").select("visit_id", "patient_id")


# Component codes given to the vital-sign columns.
VITAL_CODES = {"bp_diastolic": -5, "bp_systolic": -4, "pulse": -3, "temperature": -2, "weight_kg": -1}


@query("b_unpivot_labs_vitals", "B23 D6 D1 F7", """
select distinct patient_id, component_id, result_date, value from (
  select patient_id, cast(component_id as bigint) as component_id, result_date, value from labs
  union all
  select patient_id, cast(-4 as bigint), contact_date, bp_systolic from vitals
  union all select patient_id, cast(-3 as bigint), contact_date, pulse from vitals
  union all select patient_id, cast(-2 as bigint), contact_date, temperature from vitals
  union all select patient_id, cast(-1 as bigint), contact_date, weight_kg from vitals)
""")
def b_unpivot_labs_vitals(spark, sf_dir):
    from kairos.operators.features import labs_vitals
    return labs_vitals(fx.labs(spark, sf_dir), fx.vitals(spark, sf_dir), VITAL_CODES)


@query("b_split_folds", "D9 D10", f"""
select patient_id,
  case when cluster_id = 7 then 3 when {dedup.id_hash_sql('patient_id')} % 100 < 80 then 0 else 2 end as split,
  cast({dedup.id_hash_sql('patient_id')} % 10 + 1 as int) as fold
from patients
""")
def b_split_folds(spark, sf_dir):
    p = fx.patients(spark, sf_dir)
    # the final test set is a fixed list of patients: here those of one cluster
    return p.select("patient_id", dedup.split_label("patient_id", held_out=F.col("cluster_id") == 7).alias("split"),
                    dedup.fold_of("patient_id", 10).alias("fold"))

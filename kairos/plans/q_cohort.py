"""Contract queries: cohort and landmarks (E1-E8) and more feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairos.operators import cohort, dedup, features, pit
from kairos.plans.registry import query, r
from kairos.sources import fixtures as fx

_SYS_START = "1995-06-01"


@query("e1_cohort", "E1 D7 B11", f"""
with p as (select patient_id, earliest_mets, death_date,
             case when death_date is not null and lfu_date > death_date then death_date else lfu_date end as lfu_date
           from patients where lfu_date is not null and lfu_date > date '{_SYS_START}' and lfu_date > earliest_mets)
select p.patient_id, p.lfu_date from p
where exists (select 1 from labs l where l.patient_id = p.patient_id and l.result_date >= p.earliest_mets)
  and exists (select 1 from notes n where n.patient_id = p.patient_id and n.contact_date >= p.earliest_mets)
  and exists (select 1 from items i where i.patient_id = p.patient_id and i.item_date >= p.earliest_mets
              and i.feature_name like 'proc_%')
""")
def e1_cohort(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    out = cohort.eligible(fx.patients(spark, sf_dir), system_start=_SYS_START, evidence=[
        (fx.labs(spark, sf_dir), "result_date"), (fx.notes(spark, sf_dir), "contact_date"),
        (it.filter(F.col("feature_name").startswith("proc_")), "item_date")])
    return out.select("patient_id", "lfu_date")


@query("e2_note_cleanup", "E2 B17 S8", """
select n.note_id, cast(datediff('day', n.update_date, p.lfu_date) as double) as fu_days,
  (n.update_date >= p.earliest_mets) and (p.dead or datediff('day', n.update_date, p.lfu_date) > 365) as include_surv_12mo,
  (not p.dead) or datediff('day', n.update_date, p.death_date) > 365 as surv_12mo
from notes n join patients p on p.patient_id = n.patient_id
where ((not p.dead) or n.contact_date < p.death_date) and ((not p.dead) or n.update_date < p.death_date)
  and n.contact_date >= p.earliest_mets - interval 365 day and n.update_date >= n.contact_date
  and datediff('day', n.update_date, p.lfu_date) >= 1
""")
def e2_note_cleanup(spark, sf_dir):
    out = cohort.clean_records(fx.notes(spark, sf_dir), fx.patients(spark, sf_dir))
    return out.select("note_id", "fu_days", "include_surv_12mo", "surv_12mo")


@query("e3_time_zero", "E3", """
select v.patient_id, min(v.visit_date) as t0 from visits v join patients p on p.patient_id = v.patient_id
where v.visit_date >= p.earliest_mets group by v.patient_id
""")
def e3_time_zero(spark, sf_dir):
    return cohort.time_zero(fx.visits(spark, sf_dir), fx.patients(spark, sf_dir))


_T0_SQL = """
select v.patient_id, min(v.visit_date) as t0 from visits v join patients p on p.patient_id = v.patient_id
where v.visit_date >= p.earliest_mets group by v.patient_id
"""


@query("e4_landmarks", "E4 C7 E6 B7 B8 S4", """
with g as (select t0.patient_id, l.landmark,
             cast(t0.t0 as timestamp) + to_microseconds(cast(l.landmark * 86400000000e0 as bigint)) as eval_date
           from t0, (select unnest([0e0, 182.5e0, 365e0, 547.5e0, 730e0, 912.5e0, 1095e0, 1277.5e0, 1460e0, 1642.5e0, 1825e0]) as landmark) l),
e as (select g.*, p.dead, p.lfu_date, p.dob from g join patients p on p.patient_id = g.patient_id
      where g.eval_date < cast(p.lfu_date as timestamp)),
k as (select * from e where exists (select 1 from visits v where v.patient_id = e.patient_id
        and cast(v.visit_date as timestamp) <= e.eval_date
        and (epoch_us(e.eval_date) - epoch_us(cast(v.visit_date as timestamp))) / 86400e6 < 182.5e0)),
o as (select patient_id, landmark, eval_date, dead,
        (epoch_us(cast(lfu_date as timestamp)) - epoch_us(eval_date)) / 86400e6 as fu_days,
        (epoch_us(eval_date) - epoch_us(cast(dob as timestamp))) / 86400e6 / 365e0 as age,
        cast(trunc((epoch_us(eval_date) - epoch_us(timestamp '2000-01-01')) / 86400e6) as int) as date_int from k)
select patient_id, landmark, eval_date, dead, round(fu_days, 4) as fu_days, round(age, 4) as age, date_int
from o where age >= 18
""", extra_views={"t0": _T0_SQL})
def e4_landmarks(spark, sf_dir):
    v, p = fx.visits(spark, sf_dir), fx.patients(spark, sf_dir)
    t0 = cohort.time_zero(v, p)
    lm = cohort.landmarks(t0, v, p)
    return lm.select("patient_id", "landmark", "eval_date", "dead", r("fu_days").alias("fu_days"),
                     r("age").alias("age"), "date_int")


def _visits_time1(spark, sf_dir):
    v = fx.visits(spark, sf_dir)
    p = fx.patients(spark, sf_dir).select("patient_id", "lfu_date", "dead")
    first = v.groupBy("patient_id").agg(F.min("visit_date").alias("_f"))
    return (v.join(first, "patient_id").join(p, "patient_id")
            .select("patient_id", "visit_id", F.datediff("visit_date", "_f").cast("double").alias("time1"),
                    F.datediff("lfu_date", "visit_date").cast("double").alias("days_to_last"), "dead"))


_VT_SQL = """
select v.patient_id, v.visit_id,
  cast(datediff('day', min(v.visit_date) over (partition by v.patient_id), v.visit_date) as double) as time1,
  cast(datediff('day', v.visit_date, p.lfu_date) as double) as days_to_last, p.dead
from visits v join patients p on p.patient_id = v.patient_id
"""


@query("e5_landmark_set", "E5 C6 C7 B12 S3", """
with c as (select vt.*, l.landmark from vt, (select unnest([0e0, 365e0, 730e0, 1095e0, 1460e0, 1825e0]) as landmark) l
           where l.landmark - vt.time1 >= 0 and vt.days_to_last + vt.time1 > l.landmark),
b as (select *, max(time1) over (partition by patient_id, landmark) as best from c)
select patient_id, visit_id, landmark, landmark * landmark as landmark_sq, time1,
  least(days_to_last - (landmark - time1), 1825e0) as fu_time,
  case when days_to_last - (landmark - time1) > 1825e0 then false else dead end as dead
from b where time1 = best
""", extra_views={"vt": _VT_SQL})
def e5_landmark_set(spark, sf_dir):
    return cohort.landmark_set(_visits_time1(spark, sf_dir), fu="days_to_last")


@query("e7_shifted_evals", "E7", """
select patient_id, visit_date as eval_date, cast(visit_date - interval 14 day as date) as eval_date_shifted
from visits where visit_type = '1-URGENT'
""")
def e7_shifted_evals(spark, sf_dir):
    tx = fx.visits(spark, sf_dir).filter(F.col("visit_type") == "1-URGENT")
    out = cohort.shifted_evals(tx, date="visit_date")
    return out.select("patient_id", "eval_date", F.col("eval_date_shifted").cast("date").alias("eval_date_shifted"))


@query("e8_code_cohort", "E8 B21", """
select patient_id, min(item_date) as first_date from items
where feature_name in (select distinct concat('diag_', p_brand) from part where p_size < 10)
group by patient_id
""")
def e8_code_cohort(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part").filter(F.col("p_size") < 10)
    codes = part.select(F.concat(F.lit("diag_"), "p_brand").alias("feature_name"))
    return cohort.code_cohort(fx.items(spark, sf_dir), codes)


# --- feature queries that need the cohort helpers -------------------------

_TRAIN_LABS_SQL = """
select l.component_id, avg(l.value) as mean, stddev_samp(l.value) as std
from labs l where l.patient_id % 10 < 8 group by l.component_id
"""


def _train_lab_stats(spark, sf_dir):
    lab = fx.labs(spark, sf_dir).withColumn("is_train", F.col("patient_id") % 10 < 8)
    return features.train_stats(lab, feature="component_id", value="value", train="is_train", sample=True)


@query("f8_standardised", "F8 S10", """
select component_id, round(mean, 4) + 0e0 as mean, round(std, 4) as std from st
""", extra_views={"st": _TRAIN_LABS_SQL})
def f8_standardised(spark, sf_dir):
    st = _train_lab_stats(spark, sf_dir)
    return st.select("component_id", r("mean").alias("mean"), r("std").alias("std"))


@query("f2_decayed_labs_unbounded", "F2 F8 C5", """
with z as (select l.patient_id, l.component_id, l.result_date, (l.value - st.mean) / st.std as value
           from labs l join st on st.component_id = l.component_id where st.std <> 0)
select v.visit_id, z.component_id,
  round(sum(pow(2e0, -datediff('day', z.result_date, v.visit_date) / 30e0) * z.value)
      / sum(pow(2e0, -datediff('day', z.result_date, v.visit_date) / 30e0)), 4) + 0e0 as value
from visits v join z on z.patient_id = v.patient_id and z.result_date <= v.visit_date
group by v.visit_id, z.component_id
""", extra_views={"st": _TRAIN_LABS_SQL})
def f2_decayed_labs_unbounded(spark, sf_dir):
    st = _train_lab_stats(spark, sf_dir)
    z = features.standardize(fx.labs(spark, sf_dir), st, feature="component_id", value="value")
    out = pit.decayed_mean_unbounded(fx.visits(spark, sf_dir), z)
    return out.select("visit_id", "component_id", r("value").alias("value"))


@query("f4_event_tiers", "F4 S1 C5", """
select v.visit_id, i.feature_name,
  case when min(datediff('day', i.item_date, v.visit_date)) <= 30 then 1e0
       when min(datediff('day', i.item_date, v.visit_date)) <= 60 then 0.5e0
       when min(datediff('day', i.item_date, v.visit_date)) <= 120 then 0.25e0 else 0.125e0 end as weight
from visits v join items i on i.patient_id = v.patient_id and i.item_date <= v.visit_date
group by v.visit_id, i.feature_name
""")
def f4_event_tiers(spark, sf_dir):
    return pit.step_weighted_presence(fx.visits(spark, sf_dir), fx.items(spark, sf_dir))


@query("f5_event_182d", "F5 C5", """
select distinct v.visit_id, i.feature_name, 1e0 as weight
from visits v join items i on i.patient_id = v.patient_id and i.item_date <= v.visit_date
 and datediff('day', i.item_date, v.visit_date) <= 182
""")
def f5_event_182d(spark, sf_dir):
    return pit.presence_within(fx.visits(spark, sf_dir), fx.items(spark, sf_dir), days=182)


@query("f6_event_table", "F6 D2 D5 B19", """
with u as (
  select patient_id, feature_name, min(item_date) as item_date from items where feature_name like 'diag_%' group by patient_id, feature_name
  union all select patient_id, feature_name, item_date from items where feature_name not like 'diag_%'),
d as (select patient_id, item_date, feature_name,
        cast(trunc((epoch_us(cast(item_date as timestamp)) - epoch_us(timestamp '2000-01-01')) / 86400e6) as int) as date_int
      from u where item_date is not null)
select patient_id, min(item_date) as item_date, feature_name, date_int from d group by patient_id, date_int, feature_name
""")
def f6_event_table(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    pref = F.regexp_extract("feature_name", "^([a-z]+_)", 1)
    srcs = []
    for p in ("diag_", "proc_", "medi_"):
        part = it.filter(pref == p).withColumn("_n", F.regexp_replace("feature_name", "^[a-z]+_", ""))
        srcs.append((part, "item_date", "_n", p))
    return features.event_table(srcs)


@query("f9_demographics", "F9", """
select v.visit_id, 'age' as feature, round(datediff('day', p.dob, v.visit_date) / 365e0, 4) as value
from visits v join patients p on p.patient_id = v.patient_id
union all
select v.visit_id, 'female', case when p.sex = 'Female' then 1e0 else 0e0 end
from visits v join patients p on p.patient_id = v.patient_id
""")
def f9_demographics(spark, sf_dir):
    d = features.demographics(fx.visits(spark, sf_dir), fx.patients(spark, sf_dir))
    return d.select("visit_id", "feature", r("value").alias("value"))


def _assembled(spark, sf_dir, materialize: bool = False):
    """F10 long feature rows at every visit; ``materialize`` writes them once to the
    shared folder when several consumers read them (cuts recomputation and lineage)."""
    from kairos.sources.writers import persist_table
    v, p = fx.visits(spark, sf_dir), fx.patients(spark, sf_dir)
    labs = pit.decayed_mean(v, fx.labs(spark, sf_dir))
    ev = pit.step_weighted_presence(v, fx.items(spark, sf_dir))
    demo = features.demographics(v, p)
    long = features.assemble([(labs, "component_id", "value", "lab"), (ev, "feature_name", "weight", "event"),
                              (demo, "feature", "value", "demo")])
    return persist_table(long, "features_long") if materialize else long


_F1_SQL = """
select v.visit_id, l.component_id,
  sum(pow(2e0, -datediff('day', l.result_date, v.visit_date) / 30e0) * l.value)
      / sum(pow(2e0, -datediff('day', l.result_date, v.visit_date) / 30e0)) as value
from visits v join labs l on l.patient_id = v.patient_id
 and l.result_date <= v.visit_date and l.result_date > v.visit_date - interval 365 day
group by v.visit_id, l.component_id
"""
_F4_SQL = """
select v.visit_id, i.feature_name,
  case when min(datediff('day', i.item_date, v.visit_date)) <= 30 then 1e0
       when min(datediff('day', i.item_date, v.visit_date)) <= 60 then 0.5e0
       when min(datediff('day', i.item_date, v.visit_date)) <= 120 then 0.25e0 else 0.125e0 end as weight
from visits v join items i on i.patient_id = v.patient_id and i.item_date <= v.visit_date
group by v.visit_id, i.feature_name
"""
_LONG_SQL = """
select visit_id, concat('lab:', cast(component_id as varchar)) as feature, 'lab' as category, value from f1
union all select visit_id, concat('event:', feature_name), 'event', weight from f4
union all select v.visit_id, 'demo:age', 'demo', datediff('day', p.dob, v.visit_date) / 365e0 from visits v join patients p on p.patient_id = v.patient_id
union all select v.visit_id, 'demo:female', 'demo', case when p.sex = 'Female' then 1e0 else 0e0 end from visits v join patients p on p.patient_id = v.patient_id
"""


@query("f10_feature_dictionary", "F10 D13", """
with d as (select feature, category, cast(count(*) as bigint) as n_present from longf group by feature, category)
select feature, category, n_present, cast(row_number() over (order by feature) - 1 as bigint) as index from d
""", extra_views={"f1": _F1_SQL, "f4": _F4_SQL, "longf": _LONG_SQL})
def f10_feature_dictionary(spark, sf_dir):
    d = features.feature_dictionary(_assembled(spark, sf_dir))
    return d.select("feature", "category", "n_present", F.col("index").cast("long"))


@query("f11_impute_standardise", "F11 S10", """
with ev as (select visit_id, patient_id % 10 < 8 as is_train from visits),
ntr as (select count(*) as n from ev where is_train),
tr as (select l.* from longf l join ev on ev.visit_id = l.visit_id where ev.is_train),
a as (select feature, category, count(value) as n, sum(value) as s, sum(value * value) as ss,
        stddev_pop(value) as sdp, avg(value) as m from tr group by feature, category),
st as (select feature, category, n,
         case when category = 'event' then s / (select n from ntr) else m end as mean,
         case when category = 'event' then sqrt(greatest(ss / (select n from ntr) - pow(s / (select n from ntr), 2), 0e0)) else sdp end as std
       from a),
z as (select l.feature, sum((l.value - st.mean) / st.std) as sum_z from longf l join st on st.feature = l.feature
      where st.std > 1e-12 group by l.feature)
select st.feature, cast(st.n as bigint) as n, round(st.mean, 4) + 0e0 as mean, round(st.std, 4) as std,
  st.std > 1e-12 as include,
  round(case when st.category = 'event' and st.std > 1e-12 then -st.mean / st.std else 0e0 end, 4) + 0e0 as fill_z,
  round(z.sum_z, 3) + 0e0 as sum_z
from st left join z on z.feature = st.feature
""", extra_views={"f1": _F1_SQL, "f4": _F4_SQL, "longf": _LONG_SQL})
def f11_impute_standardise(spark, sf_dir):
    ev = fx.visits(spark, sf_dir).select("visit_id", (F.col("patient_id") % 10 < 8).alias("is_train"))
    out = features.feature_statistics(_assembled(spark, sf_dir), ev, zero_filled=["event"])
    return out.select("feature", "n", r("mean").alias("mean"), r("std").alias("std"), "include",
                      r("fill_z").alias("fill_z"), r("sum_z", 3).alias("sum_z"))

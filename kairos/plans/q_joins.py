"""Contract queries: joins, dedup and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairos.operators import dedup, joins
from kairos.operators.running import dense_index
from kairos.plans.registry import query
from kairos.sources import fixtures as fx


@query("c1_visit_site", "C1", """
select v.visit_id, v.patient_id, p.site, v.visit_date from visits v join patients p on p.patient_id = v.patient_id
""")
def c1_visit_site(spark, sf_dir):
    p = fx.patients(spark, sf_dir).select("patient_id", "site")
    return joins.equi_join(fx.visits(spark, sf_dir), p, ["patient_id"]).select(
        "visit_id", "patient_id", "site", "visit_date")


@query("c2_same_day_labs", "C2", """
select v.visit_id, cast(count(*) as bigint) as n_labs
from visits v join labs l on l.patient_id = v.patient_id and l.result_date = v.visit_date
group by v.visit_id
""")
def c2_same_day_labs(spark, sf_dir):
    lab = fx.labs(spark, sf_dir).select("patient_id", F.col("result_date").alias("visit_date"))
    j = joins.equi_join(fx.visits(spark, sf_dir).select("visit_id", "patient_id", "visit_date"), lab,
                        ["patient_id", "visit_date"])
    return j.groupBy("visit_id").agg(F.count(F.lit(1)).alias("n_labs"))


@query("c3_patient_notes", "C3", """
select p.patient_id, n.n_notes from patients p
left join (select patient_id, cast(count(*) as bigint) as n_notes from notes group by patient_id) n
  on n.patient_id = p.patient_id
""")
def c3_patient_notes(spark, sf_dir):
    n = fx.notes(spark, sf_dir).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_notes"))
    return joins.equi_join(fx.patients(spark, sf_dir).select("patient_id"), n, ["patient_id"], "left")


@query("c4_semi", "C4", """
select patient_id, site from patients p where exists (select 1 from notes n where n.patient_id = p.patient_id)
""")
def c4_semi(spark, sf_dir):
    return joins.semi(fx.patients(spark, sf_dir).select("patient_id", "site"), fx.notes(spark, sf_dir),
                      ["patient_id"])


@query("c4_anti", "C4 D8", """
select patient_id, site from patients p where not exists (select 1 from notes n where n.patient_id = p.patient_id)
""")
def c4_anti(spark, sf_dir):
    return joins.anti(fx.patients(spark, sf_dir).select("patient_id", "site"), fx.notes(spark, sf_dir),
                      ["patient_id"])


# Landmark grid for nearest-landmark assignment (half years, 0 to 5 years).
NEAREST_GRID = [182.5 * i for i in range(11)]


@query("c8_nearest", "C8", """
with f as (select visit_id, patient_id, visit_date,
                  datediff('day', min(visit_date) over (partition by patient_id), visit_date) as time1 from visits)
select visit_id, time1, cast(least(greatest(ceil(time1 / 182.5e0 - 0.5e0), 0), 10) as int) * 182.5e0 as landmark from f
""")
def c8_nearest(spark, sf_dir):
    v = fx.visits(spark, sf_dir)
    first = v.groupBy("patient_id").agg(F.min("visit_date").alias("_f"))
    v = v.join(first, "patient_id").withColumn("time1", F.datediff("visit_date", "_f"))
    return v.select("visit_id", "time1", joins.nearest_landmark("time1", NEAREST_GRID).alias("landmark"))


@query("c9_course_dedup", "C9 S5", """
with d as (select distinct patient_id, visit_date from visits),
l as (select patient_id, visit_date, lag(visit_date) over (partition by patient_id order by visit_date) as prev from d)
select patient_id, visit_date from l where prev is null or datediff('day', prev, visit_date) >= 14
""")
def c9_course_dedup(spark, sf_dir):
    v = fx.visits(spark, sf_dir).select("patient_id", "visit_date")
    return joins.drop_close_followers(v, key="patient_id", time="visit_date", days=14)


@query("c10_top_groups", "C10", """
with s as (select cluster_id, count(*) as n from patients group by cluster_id),
r as (select cluster_id, row_number() over (order by n desc, cluster_id) as rk from s)
select p.patient_id, p.cluster_id, cast(least(r.rk, 13) as int) as group_rank
from patients p join r on r.cluster_id = p.cluster_id
""")
def c10_top_groups(spark, sf_dir):
    p = fx.patients(spark, sf_dir).select("patient_id", "cluster_id")
    return joins.top_groups_lookup(p, "cluster_id", 12).select("patient_id", "cluster_id", "group_rank")


_CODES_SQL = """
select concat('diag_', p_brand) as feature_name, p_name as code_desc, p_partkey from part
"""


@query("c11_enrich", "C11 D4", """
with c as (select feature_name, code_desc, row_number() over (partition by feature_name order by p_partkey) as rn from codes)
select i.patient_id, i.item_date, i.feature_name, c.code_desc
from items i left join c on c.feature_name = i.feature_name and c.rn = 1
""", extra_views={"codes": _CODES_SQL})
def c11_enrich(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    codes = part.select(F.concat(F.lit("diag_"), "p_brand").alias("feature_name"),
                        F.col("p_name").alias("code_desc"), "p_partkey")
    return joins.enrich_codes(fx.items(spark, sf_dir), codes, code="feature_name", order=["p_partkey"],
                              keep=["code_desc"]).select("patient_id", "item_date", "feature_name", "code_desc")


@query("d1_distinct", "D1", "select distinct patient_id, item_date, feature_name from items")
def d1_distinct(spark, sf_dir):
    return fx.items(spark, sf_dir).dropDuplicates()


@query("d2_keep_first", "D2 S2", """
select patient_id, visit_id, visit_date, visit_type from (
  select *, row_number() over (partition by patient_id order by visit_date, visit_id) as rn from visits) where rn = 1
""")
def d2_keep_first(spark, sf_dir):
    v = fx.visits(spark, sf_dir)
    return dedup.keep_first(v, ["patient_id"], ["visit_date", "visit_id"]).select(
        "patient_id", "visit_id", "visit_date", "visit_type")


@query("d3_first_non_null", "D3 B3 S2", """
with v as (select patient_id, contact_date, nullif(temperature, 0e0) as temperature,
                  nullif(bp_systolic, 0e0) as bp_systolic from vitals)
select patient_id,
  first(temperature order by contact_date, temperature) filter (where temperature is not null) as temperature,
  first(bp_systolic order by contact_date, bp_systolic) filter (where bp_systolic is not null) as bp_systolic
from v group by patient_id
""")
def d3_first_non_null(spark, sf_dir):
    from kairos.operators.rows import sentinel_to_null
    v = fx.vitals(spark, sf_dir).select("patient_id", "contact_date",
                                        sentinel_to_null("temperature", 0.0).alias("temperature"),
                                        sentinel_to_null("bp_systolic", 0.0).alias("bp_systolic"))
    return dedup.first_non_null(v, ["patient_id"], "contact_date", ["temperature", "bp_systolic"])


@query("d4_dup_keys", "D4", """
select patient_id, visit_date, cast(count(*) as bigint) as n from visits group by patient_id, visit_date having count(*) > 1
""")
def d4_dup_keys(spark, sf_dir):
    return dedup.duplicated_keys(fx.visits(spark, sf_dir), ["patient_id", "visit_date"])


@query("d5_first_occurrence", "D5", """
select patient_id, feature_name, min(item_date) as item_date from items group by patient_id, feature_name
""")
def d5_first_occurrence(spark, sf_dir):
    return dedup.first_occurrence(fx.items(spark, sf_dir), ["patient_id", "feature_name"], "item_date")


@query("d7_intersect", "D7", """
select distinct patient_id from labs where patient_id in (select patient_id from items)
  and patient_id in (select patient_id from notes)
""")
def d7_intersect(spark, sf_dir):
    return dedup.intersect_keys("patient_id", fx.labs(spark, sf_dir), fx.items(spark, sf_dir),
                                fx.notes(spark, sf_dir))


@query("d8_difference", "D8", """
select distinct patient_id from visits where patient_id not in (select patient_id from notes)
""")
def d8_difference(spark, sf_dir):
    return dedup.difference_keys("patient_id", fx.visits(spark, sf_dir), fx.notes(spark, sf_dir))


@query("d11_top_features", "D11", """
select feature_name, cast(count(*) as bigint) as n, cast(row_number() over (order by count(*) desc, feature_name) as int) as rank
from items group by feature_name order by count(*) desc, feature_name limit 10
""")
def d11_top_features(spark, sf_dir):
    t = dedup.top_n_by_frequency(fx.items(spark, sf_dir), "feature_name", 10)
    return t.select("feature_name", "n", F.col("rank").cast("int"))


@query("d12_large_groups", "D12", """
select feature_name, cast(count(*) as bigint) as n from items
where feature_name in (select feature_name from items group by feature_name having count(*) > 100)
group by feature_name
""")
def d12_large_groups(spark, sf_dir):
    kept = dedup.keep_large_groups(fx.items(spark, sf_dir), ["feature_name"], 100)
    return kept.groupBy("feature_name").agg(F.count(F.lit(1)).alias("n"))


@query("d13_encode", "D13", """
select feature_name, cast(row_number() over (order by feature_name) - 1 as bigint) as index
from (select distinct feature_name from items)
""")
def d13_encode(spark, sf_dir):
    return dense_index(fx.items(spark, sf_dir), "feature_name").select(
        "feature_name", F.col("index").cast("long"))

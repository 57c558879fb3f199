"""Contract queries: sources and sinks.

Each query writes its intermediate files under the shared checkpoint folder
of the session and reads them back, so the reader and the writer are both
exercised on the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairos.operators import models as md
from kairos.plans.q_models import _LABEL_SQL
from kairos.plans.q_survival import SV_SQL, surv_base
from kairos.plans.registry import query
from kairos.sources import fixtures as fx
from kairos.sources import readers as rd
from kairos.sources import writers as wr


@query("a2_parquet_roundtrip", "A2", """
select visit_type, cast(count(*) as bigint) as n, min(visit_date) as first_date, max(visit_date) as last_date
from visits group by visit_type
""")
def a2_parquet_roundtrip(spark, sf_dir):
    path = wr.write_parquet(fx.visits(spark, sf_dir), wr.shared_path(spark, "visits"), partition_by=["visit_type"])
    back = rd.read_parquet(spark, path)
    return back.groupBy("visit_type").agg(F.count(F.lit(1)).alias("n"), F.min("visit_date").alias("first_date"),
                                          F.max("visit_date").alias("last_date"))


_PAT_SCHEMA = T.StructType([
    T.StructField("patient_id", T.LongType()), T.StructField("site", T.StringType()),
    T.StructField("score_a", T.DoubleType()), T.StructField("dob", T.DateType()),
    T.StructField("death_date", T.DateType()), T.StructField("dead", T.BooleanType())])


@query("a3_a7_csv_roundtrip", "A3 A7 B3", """
select patient_id, site, score_a, dob, death_date, dead from patients
""")
def a3_a7_csv_roundtrip(spark, sf_dir):
    p = fx.patients(spark, sf_dir).select(*[f.name for f in _PAT_SCHEMA.fields])
    path = wr.shared_path(spark, "patients_csv")
    p.write.mode("overwrite").option("header", True).option("nullValue", "NULL").csv(path)
    return rd.read_csv(spark, path, _PAT_SCHEMA, null_value="NULL")


@query("a6_extracts", "A6 D6 B10", """
select patient_id, visit_id, make_date(year(visit_date), 12, 31) as file_date,
  case when year(visit_date) % 2 = 1 then visit_date else make_date(year(visit_date), 12, 31) + 4 end as appointment
from visits
""")
def a6_extracts(spark, sf_dir):
    """One extract per year of visits; those of even years have no appointment column."""
    v = fx.visits(spark, sf_dir).withColumn("y", F.year("visit_date")).withColumn("file", F.concat(F.col("y").cast("string"), F.lit("1231")))
    base = wr.shared_path(spark, "extracts")
    years = sorted(r["y"] for r in v.select("y").distinct().collect())  # calendar years
    paths = []
    for odd in (1, 0):
        cols = ["patient_id", "visit_id", "file", *([F.col("visit_date").alias("appointment")] if odd else [])]
        e = v.filter(F.col("y") % 2 == odd).select(*cols)
        e.write.mode("overwrite").option("header", True).partitionBy("file").csv(f"{base}/extract{odd}")
        paths += [f"{base}/extract{odd}/file={y}1231" for y in years if y % 2 == odd]
    out = rd.read_extracts(spark, paths, {"patient_id": "bigint", "visit_id": "bigint", "appointment": "date"},
                           date_pattern=r"/file=(\d{8})", fill_missing={"appointment": 4})
    return out.select("patient_id", "visit_id", "file_date", "appointment")


@query("a8_persist_labels", "A8 H2", """
select patient_id, array_to_string(s, '') as survived from lab
""", extra_views={"sv": SV_SQL, "lab": _LABEL_SQL})
def a8_persist_labels(spark, sf_dir):
    b = surv_base(spark, sf_dir)
    s, _ = md.label_arrays("time", "event")
    back = wr.persist_table(b.select("patient_id", s.alias("survived")), "labels")
    return back.select("patient_id", F.array_join("survived", "").alias("survived"))


@query("a9_timestamps", "A9 B4", """
select event_id, strptime(substr(strftime(ts, '%Y-%m-%d %H:%M:%S'), 1, 16), '%Y-%m-%d %H:%M') as ts_text, event_type
from events
""")
def a9_timestamps(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"), "event_type")
    return rd.convert_timestamps(e)


_CONFIG = {"labs": {"process": True}, "vitals": {"process": True}, "items": {"process": False},
           "notes": {"process": False}}


@query("a10_config_sources", "A10", """
select 'labs' as source, cast(count(*) as bigint) as n from labs union all
select 'vitals', cast(count(*) as bigint) from vitals
""")
def a10_config_sources(spark, sf_dir):
    loaders = {k: (lambda k=k: fx.view(spark, sf_dir, k)) for k in ("labs", "vitals", "items", "notes")}
    dfs = rd.load_configured(spark, _CONFIG, loaders)
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "n") for name, d in dfs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("a5_text_folder", "A5", """
select note_id, md5(note_text) as text_md5 from notes
""")
def a5_text_folder(spark, sf_dir):
    """All notes written into few container files and read back whole."""
    path = wr.write_packed_texts(fx.notes(spark, sf_dir), wr.shared_path(spark, "note_files"), doc="note_id", text="note_text")
    back = rd.read_packed_texts(spark, path)
    return back.select(F.col("doc").cast("long").alias("note_id"), F.md5("text").alias("text_md5"))

"""Views of the driver tables shaped like the longitudinal inputs.

The driver ships TPC-H-style tables; these functions derive the patient,
visit, lab, vital, item, note and note-outcome views from them with
DataFrame built-ins only (the same definitions are written as DuckDB SQL in
``kairos.plans.oracle``). Every view reads only the columns it needs, so the
parquet scans are pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _day(c: str):
    return F.to_date(F.col(c))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per patient with at least one visit.

    Orders are pre-aggregated per customer before the join, so the shuffle
    carries one row per customer instead of one per order.
    """
    o = (table(spark, sf_dir, "orders")
         .select(F.col("o_custkey").alias("patient_id"), _day("o_orderdate").alias("d"))
         .groupBy("patient_id")
         .agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.count(F.lit(1)).alias("n_visits")))
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("patient_id"), F.col("c_nationkey").cast("int").alias("cluster_id"),
        F.col("c_mktsegment").alias("site"), F.col("c_acctbal").alias("score_a"))
    k = F.col("patient_id")
    lfu = F.date_add(F.col("last_d"), (F.lit(30) + k % 700).cast("int"))
    return (c.join(o, "patient_id")
            .select(
                "patient_id", "cluster_id", "site", "score_a",
                F.when(k % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")).alias("sex"),
                F.date_add(F.lit("1930-01-01").cast("date"), ((k * 37) % 18250).cast("int")).alias("dob"),
                F.date_add(F.col("first_d"), (k % 400).cast("int")).alias("earliest_mets"),
                lfu.alias("lfu_date"),
                F.when(k % 3 != 0, lfu).alias("death_date"),
                (k % 3 != 0).alias("dead"),
                F.col("n_visits")))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("visit_id"), F.col("o_custkey").alias("patient_id"),
        _day("o_orderdate").alias("visit_date"), F.col("o_orderpriority").alias("visit_type"))


def _lines_with_patient(spark: SparkSession, sf_dir: str, cols, where=None) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    if where is not None:
        li = li.filter(where)
    li = li.select("l_orderkey", *cols)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey)


def labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _lines_with_patient(spark, sf_dir, ["l_suppkey", "l_shipdate", "l_quantity"])
    return j.select(F.col("o_custkey").alias("patient_id"), (F.col("l_suppkey") % 50).alias("component_id"),
                    _day("l_shipdate").alias("result_date"), F.col("l_quantity").alias("value"))


def vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _lines_with_patient(spark, sf_dir,
                            ["l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                            where=F.col("l_linenumber") == 1)
    return j.select(F.col("o_custkey").alias("patient_id"), _day("l_shipdate").alias("contact_date"),
                    F.col("l_quantity").alias("pulse"), F.col("l_extendedprice").alias("weight_kg"),
                    F.col("l_discount").alias("temperature"), F.col("l_tax").alias("bp_systolic"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnosis / procedure / medication events from line numbers 1, 2, 3.

    One pass over lineitem (line numbers 1-3 pushed to the scan), one join
    each to orders and part, and the prefix chosen per line number; this is
    the same relation as the three-way union of the oracle text.
    """
    li = (table(spark, sf_dir, "lineitem").filter(F.col("l_linenumber").isin(1, 2, 3))
          .select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    n = F.col("l_linenumber")
    name = (F.when(n == 1, F.concat(F.lit("diag_"), F.col("p_brand")))
            .when(n == 2, F.concat(F.lit("proc_"), F.col("p_type")))
            .otherwise(F.concat(F.lit("medi_"), F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)))))
    return j.select(F.col("o_custkey").alias("patient_id"), _day("l_shipdate").alias("item_date"),
                    name.alias("feature_name"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of every tenth customer, so patients with notes grow with the data and notes per patient do not.

    Consecutive pairs of a patient's notes share their days.
    """
    n = table(spark, sf_dir, "customer").agg(F.greatest(F.floor(F.count(F.lit(1)) / 10), F.lit(1)).alias("np")).scalar()
    d = table(spark, sf_dir, "documents").withColumn("_np", n)
    k = F.col("doc_id")
    slot, pair = k % F.col("_np"), F.expr("doc_id div _np div 2")
    day = ((pair * 791 + slot * 37) % 2400).cast("int")
    base = F.lit("1995-01-01").cast("date")
    return d.select(
        k.alias("note_id"), (slot * 10 + 1).alias("patient_id"), F.date_add(base, day).alias("contact_date"),
        F.date_add(base, (day + pair % 3).cast("int")).alias("update_date"),
        F.col("source").alias("department"), F.col("text").alias("note_text"))


def note_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("note_id"), F.col("quality").alias("surv_12mo"),
        (F.col("doc_id") % 10 < 8).alias("is_train"))


VIEWS = {
    "patients": patients, "visits": visits, "labs": labs, "vitals": vitals,
    "items": items, "notes": notes, "note_outcome": note_outcome,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name](spark, sf_dir)

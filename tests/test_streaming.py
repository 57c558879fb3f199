"""The micro-batch runner gives the batch answer."""

import datetime as dt
import os

from kairos.operators import pit
from kairos.sources.writers import shared_path
from kairos.streaming.incremental import run_incremental


def test_incremental_equals_batch(spark):
    base = shared_path(spark, "stream")
    src = os.path.join(base, "evals")
    d0 = dt.date(2021, 1, 1)
    ev_rows = [(p, p * 10 + k, d0 + dt.timedelta(days=40 * k + p)) for p in range(3) for k in range(6)]
    schema = "patient_id long, visit_id long, visit_date date"
    # evaluation rows arrive in two files
    spark.createDataFrame(ev_rows[:9], schema).write.mode("overwrite").parquet(os.path.join(src, "part1"))
    spark.createDataFrame(ev_rows[9:], schema).write.mode("overwrite").parquet(os.path.join(src, "part2"))
    labs = spark.createDataFrame([(p, c, d0 + dt.timedelta(days=17 * i + p), float(i + c))
                                  for p in range(3) for c in range(2) for i in range(15)],
                                 "patient_id long, component_id long, result_date date, value double")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
    q = run_incremental(stream, lambda ev: pit.decayed_mean(ev, labs), sink=os.path.join(base, "out"),
                        checkpoint=os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    got = {(r["visit_id"], r["component_id"]): round(r["value"], 10)
           for r in spark.read.parquet(os.path.join(base, "out")).collect()}
    exp = {(r["visit_id"], r["component_id"]): round(r["value"], 10)
           for r in pit.decayed_mean(spark.createDataFrame(ev_rows, schema), labs).collect()}
    assert got == exp and len(exp) > 10

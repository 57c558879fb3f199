"""Contract queries: point-in-time features."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairos.operators import pit
from kairos.plans.registry import query, r
from kairos.sources import fixtures as fx


@query("f1_decayed_labs", "C5 F1", """
select v.visit_id, l.component_id,
  round(sum(pow(2e0, -datediff('day', l.result_date, v.visit_date) / 30e0) * l.value)
      / sum(pow(2e0, -datediff('day', l.result_date, v.visit_date) / 30e0)), 4) + 0e0 as value
from visits v join labs l on l.patient_id = v.patient_id
 and l.result_date <= v.visit_date and l.result_date > v.visit_date - interval 365 day
where l.value is not null
group by v.visit_id, l.component_id
""")
def f1_decayed_labs(spark, sf_dir):
    out = pit.decayed_mean(fx.visits(spark, sf_dir), fx.labs(spark, sf_dir))
    return out.select("visit_id", "component_id", r("value").alias("value"))

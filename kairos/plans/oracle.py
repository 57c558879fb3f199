"""DuckDB texts of the fixture views, used to build ``oracle_sql()`` entries.

Each oracle query is ``WITH <needed views> <body>``; the views are the same
relations ``kairos.sources.fixtures`` builds with the DataFrame API.
Dialect notes: double literals are written ``30e0`` (``30.0`` is DECIMAL in
Spark SQL), day differences use ``datediff('day', a, b)``.
"""

from __future__ import annotations

import re

VIEW_SQL = {
    "patients": """
select c_custkey as patient_id, cast(c_nationkey as int) as cluster_id, c_mktsegment as site, c_acctbal as score_a,
 case when c_custkey % 2 = 0 then 'Female' else 'Male' end as sex,
 date '1930-01-01' + cast((c_custkey * 37) % 18250 as int) as dob,
 min(cast(o_orderdate as date)) + cast(c_custkey % 400 as int) as earliest_mets,
 max(cast(o_orderdate as date)) + cast(30 + c_custkey % 700 as int) as lfu_date,
 case when c_custkey % 3 <> 0 then max(cast(o_orderdate as date)) + cast(30 + c_custkey % 700 as int) end as death_date,
 c_custkey % 3 <> 0 as dead, count(*) as n_visits
from customer join orders on o_custkey = c_custkey group by c_custkey, c_nationkey, c_mktsegment, c_acctbal""",
    "visits": """
select o_orderkey as visit_id, o_custkey as patient_id, cast(o_orderdate as date) as visit_date, o_orderpriority as visit_type from orders""",
    "labs": """
select o_custkey as patient_id, l_suppkey % 50 as component_id, cast(l_shipdate as date) as result_date, l_quantity as value
from lineitem join orders on l_orderkey = o_orderkey""",
    "vitals": """
select o_custkey as patient_id, cast(l_shipdate as date) as contact_date, l_quantity as pulse, l_extendedprice as weight_kg, l_discount as temperature, l_tax as bp_systolic
from lineitem join orders on l_orderkey = o_orderkey where l_linenumber = 1""",
    "items": """
select o_custkey as patient_id, cast(l_shipdate as date) as item_date, concat('diag_', p_brand) as feature_name
from lineitem join orders on l_orderkey = o_orderkey join part on p_partkey = l_partkey where l_linenumber = 1
union all
select o_custkey, cast(l_shipdate as date), concat('proc_', p_type)
from lineitem join orders on l_orderkey = o_orderkey join part on p_partkey = l_partkey where l_linenumber = 2
union all
select o_custkey, cast(l_shipdate as date), concat('medi_', split_part(p_name, ' ', 1))
from lineitem join orders on l_orderkey = o_orderkey join part on p_partkey = l_partkey where l_linenumber = 3""",
    "notes": """
select doc_id as note_id, (doc_id % np) * 10 + 1 as patient_id,
 date '1995-01-01' + cast(((doc_id // np // 2) * 791 + (doc_id % np) * 37) % 2400 as int) as contact_date,
 date '1995-01-01' + cast(((doc_id // np // 2) * 791 + (doc_id % np) * 37) % 2400 + doc_id // np // 2 % 3 as int) as update_date,
 source as department, text as note_text
from documents, (select greatest(count(*) // 10, 1) as np from customer)""",
    "note_outcome": """
select d.doc_id as note_id, l.quality as surv_12mo, d.doc_id % 10 < 8 as is_train from documents d join labels l on l.doc_id = d.doc_id""",
}

# views that reference other views must come after them
_ORDER = list(VIEW_SQL)


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the fixture views (and ``extra`` CTEs) it mentions."""
    ctes = dict(VIEW_SQL)
    ctes.update(extra or {})
    order = _ORDER + [k for k in (extra or {}) if k not in VIEW_SQL]
    text = body
    needed: list[str] = []
    changed = True
    while changed:
        changed = False
        for name in order:
            if name in needed:
                continue
            probe = text + " ".join(ctes[n] for n in needed)
            if re.search(rf"\b{name}\b", probe) and not _is_base(name):
                needed.append(name)
                changed = True
    parts = [f"{n} as ({ctes[n]})" for n in order if n in needed]
    if not parts:
        return body
    head = "with " + ",\n".join(parts)
    m = re.match(r"\s*with\s+", body, flags=re.IGNORECASE)
    if m:  # merge with the body's own CTE list
        return head + ",\n" + body[m.end():]
    return head + "\n" + body


def _is_base(name: str) -> bool:
    return False

"""Driver contract: entry() runs; every oracle-backed query equals its DuckDB text at sf0.001."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as se
from kairos.sources.fixtures import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

def _norm(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = se.entry(spark)
    assert df.columns == ["visit_id", "component_id", "value"]
    assert df.count() > 0


def test_registry_covers_every_oracle():
    q, o = se.queries(), se.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100


@pytest.mark.parametrize("name", sorted(se.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = se.queries()[name](spark, SF)
    res = con.execute(se.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())

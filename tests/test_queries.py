"""The registered queries against their SQL twins, and the plans of a few of them."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return int(v) if hasattr(v, "bit_length") and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    sql = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda row: tuple(plain(v) for v in row)
    want = sorted((key(r) for r in sql.fetchall()), key=repr)
    assert want and sorted((key(r) for r in got.select(*names).collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["claim_batch"](spark, SF))
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id" in plan(catalog.QUERIES["event_tail"](spark, SF))
    gate = plan(catalog.QUERIES["quality_by_source"](spark, SF))
    assert "Python" not in gate and "ReadSchema: struct<text:string,source:string>" in gate and gate.count("Exchange hashpartitioning") == 1
    assert "Exchange" not in plan(catalog.QUERIES["quality_gate"](spark, SF))

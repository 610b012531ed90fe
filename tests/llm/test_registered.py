"""The registered opN queries on the small tables, with SQL where there is some."""

from __future__ import annotations

import duckdb
import pytest

from quire.llm import queries

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_covers_its_table(spark, name):
    got = queries.QUERIES[name](spark, SF)
    rows = got.collect()
    source, key = ("pages", "page_id") if name.startswith(("op4", "op5")) else ("items", "item_id") if name.startswith("op13") else ("documents", "doc_id")
    want = {r[0] for r in duckdb.sql(f"select {key} from '{SF}/{source}.parquet'").fetchall()}
    assert {r[key] for r in rows} == want
    if not name.startswith(("op1_", "op13_")):
        assert len(rows) == len(want)
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages", "items", "sale_lines"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        sql = con.execute(queries.ORACLES[name])
        names = [d[0] for d in sql.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(sql.fetchall(), key=repr) == sorted((tuple(r[c] for c in names) for r in rows), key=repr)

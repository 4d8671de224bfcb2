"""Every query that SQL can express against DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import re

import pytest

from codexframe.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, sql, name):
    got = QUERIES[name](spark, sf)
    want = sql.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    value = lambda v: round(v, 9) if isinstance(v, float) else v
    key = lambda r: tuple((v is None, str(v)) for v in r)
    ours = sorted((tuple(value(r[c]) for c in columns) for r in got.collect()), key=key)
    assert ours == sorted((tuple(value(v) for v in r) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_plans(spark, sf):
    plan = lambda name: QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(label, \[1,2,3\]\)", plan("vector_topk_filtered"))
    assert "TakeOrderedAndProject" in plan("vector_topk") and plan("vector_topk").count("ArrowEvalPython") == 1
    assert "CartesianProduct" not in plan("rel_some_or_none")


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["chunk_id", "document_id", "score"] and rows.count() > 0

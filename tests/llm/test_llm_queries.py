from __future__ import annotations

import duckdb
import pytest

from codexframe.llm.queries import oracle_sql, queries

TABLES = ("documents", "embeddings", "pages", "labels")


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, sf, sql, name):
    got = queries()[name](spark, sf)
    want = sql.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    ours = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    assert ours == sorted(map(tuple, want.fetchall()), key=key)


def test_all_operators_and_the_pipeline_are_registered():
    names = queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in names)] == [] and "pipeline" in names

"""Queries on larger tables: keys above those that they make up, and steps whose memory or time must not outgrow the input."""

from __future__ import annotations

import duckdb
import pytest

from codexframe.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def many_parts(spark, tmp_path_factory):
    """Parts whose numbers pass a million."""
    folder = str(tmp_path_factory.mktemp("parts"))
    rows = [(k, f"part {k}", f"Brand#{k % 5}", "PROMO" if k % 2 else "ECONOMY", 41 if k % 3 else 7, float(k)) for k in (0, 1, 2, 3, 1000000, 1000001, 1000002, 1000003)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


def same_as_sql(spark, folder: str, name: str) -> None:
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{folder}/part.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, folder)
    assert got.columns == columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_inserted_copies_with_the_number_of_another_part(spark, many_parts):
    same_as_sql(spark, many_parts, "insert_skip_duplicates")


def test_upserted_copies_with_the_number_of_another_part(spark, many_parts):
    same_as_sql(spark, many_parts, "upsert_rows")


def test_resetting_tags_sorts_no_links(spark):
    from codexframe.operators import taxonomy

    rows = [(d, s) for d in ("a", "b", None) for s in ("AI", "MERGED", "USER", "PENDING")]
    links = spark.createDataFrame(rows, "document_id string, source string")
    reviews = spark.createDataFrame(rows, "document_id string, status string")
    asked = spark.createDataFrame([("a",), ("a",), (None,)], "document_id string")
    sent = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        left = taxonomy.reset_document_tags(links, reviews, asked)
        shown = [df._jdf.queryExecution().executedPlan().toString() for df in left]
        got = [sorted((tuple(r) for r in df.collect()), key=str) for df in left]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", sent)
    assert got[0] == sorted((r for r in rows if r[0] != "a" or r[1] not in ("AI", "MERGED")), key=str)
    assert got[1] == sorted((r for r in rows if r[0] != "a" or r[1] != "PENDING"), key=str)
    assert all("ShuffledHashJoin" in s and "Sort" not in s.replace("SortAggregate", "") for s in shown)


def test_the_built_in_model_hashes_a_word_once(monkeypatch):
    import hashlib

    import numpy as np

    from codexframe.operators import embedding

    calls = []

    class Counted:
        blake2b = staticmethod(lambda *a, **k: calls.append(1) or hashlib.blake2b(*a, **k))

    monkeypatch.setattr(embedding, "hashlib", Counted)
    monkeypatch.setattr(embedding, "REMEMBERED", 2)
    texts = ["One one TWO", "", "two one two", "\ud800 three three"]
    got = embedding.hashing_embedder(8)(texts)
    assert len(calls) == 4  # the third and fourth word after forgetting
    want = np.zeros((4, 8), np.float32)
    for row, text in enumerate(texts):
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            want[row, h % 8] += 1.0 if h >> 63 else -1.0
        want[row] /= max(np.linalg.norm(want[row]), 1e-9)
    assert np.allclose(got, want, atol=1e-6)


def test_tiles_hold_the_products_of_a_slab_alone(spark):
    import numpy as np
    import pyarrow as pa

    from codexframe.operators import tiles

    rows = spark.range(2000).selectExpr("1 as g", "2 as d", "id", "array(double(id), 1D) as v")

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        return pa.table({"n": np.array([x.num_rows * y.num_rows])})

    got = [r.n for r in tiles.meet(rows, rows, compare, "n long").collect()]
    assert sum(got) == 2000 * 2000 and max(got) <= 512 * tiles.TILE and len(got) == 4

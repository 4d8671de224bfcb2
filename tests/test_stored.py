"""Stored layouts: what is read, what is rewritten, and how near the index comes to brute force; and requests to a model."""

from __future__ import annotations

import threading
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexframe.operators import embedding, search
from codexframe.operators.vector_index import VectorIndex
from codexframe.queries import QUERIES
from codexframe.sources.layout import BUCKET, BucketedTable


def files(path) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for f in Path(path).rglob("*.parquet"):
        out.setdefault(f.parent.name, set()).add(f.name)
    return out


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows_read(df) -> int:
    """Rows that the scans of a collected query gave."""
    df.collect()
    node, total = [df._jdf.queryExecution().executedPlan()], 0
    while node:
        at = node.pop()
        if at.nodeName().startswith("AdaptiveSparkPlan"):
            node.append(at.executedPlan())
            continue
        if at.nodeName().startswith("Scan parquet"):
            total += at.metrics().get("numOutputRows").get().value()
        children = at.children()
        node += [children.apply(i) for i in range(children.size())]
    return total


def test_a_read_opens_its_bucket_alone(spark, tmp_path):
    rows = [(f"k{i % 40}", i) for i in range(4000)] + [(None, -1)]
    table = BucketedTable(spark, str(tmp_path / "t"), "key", 16).create(spark.createDataFrame(rows, "key string, n int"))
    assert sorted(r.n for r in table.of("k7").collect()) == list(range(7, 4000, 40))
    assert rows_read(table.of("k7")) < 4000 / 4 and "PartitionFilters: [" in plan(table.of("k7")) and f"{BUCKET}#" in plan(table.of("k7"))
    assert table.of("nobody").count() == 0 and table.of(None).count() == 0 and table.of("k1", "k2").count() == 200
    asked = spark.createDataFrame([("k3",), ("k3",), ("none",), (None,)], "key string")
    assert table.of_all(asked).count() == 100
    assert table.rows().count() == 4001 and set(table.rows().columns) == {"key", "n"}


def test_writes_leave_other_buckets_files_alone(spark, tmp_path):
    rows = [(i % 50, i, "a") for i in range(1000)]
    table = BucketedTable(spark, str(tmp_path / "t"), "key", 8).create(spark.createDataFrame(rows, "key int, n int, s string"))
    want = {n: (k, s) for k, n, s in rows}

    def same(touched: list[int], before: dict) -> None:
        after = files(table.path)
        for folder in before:
            assert (after.get(folder) == before[folder]) == (int(folder.split("=")[1]) not in touched)
        assert {r.n: (r.key, r.s) for r in table.rows().collect()} == want
        assert not [p for p in tmp_path.iterdir() if "_next" in p.name]

    before = files(table.path)
    touched = table.update(F.col("n") == 7, {"s": "b"})
    want[7] = (7, "b")
    assert len(touched) == 1
    same(touched, before)

    before = files(table.path)
    touched = table.delete((F.col("key") == 3) | (F.col("n") == 9))
    want = {n: v for n, v in want.items() if v[0] != 3 and n != 9}
    assert len(touched) <= 2
    same(touched, before)

    before = files(table.path)
    touched = table.upsert(spark.createDataFrame([(8, 8, "c"), (8, 5000, "d")], "key int, n int, s string"), ["key", "n"])
    want |= {8: (8, "c"), 5000: (8, "d")}
    assert len(touched) == 1
    same(touched, before)

    before = files(table.path)
    touched = table.replace_children(spark.createDataFrame([(11, 6000, "e"), (11, 6001, "e")], "key int, n int, s string"))
    want = {n: v for n, v in want.items() if v[0] != 11} | {6000: (11, "e"), 6001: (11, "e")}
    assert len(touched) == 1
    same(touched, before)

    before = files(table.path)
    assert table.update(F.col("n") == -1, {"s": "z"}) == [] and files(table.path) == before
    touched = table.delete_keys(spark.createDataFrame([(k,) for k in range(50)], "key int"))  # every bucket is left empty
    want = {}
    assert files(table.path) == {} and len(touched) == 8
    with pytest.raises(ValueError, match="bucket"):
        table.update(F.col("n") == 1, {"key": 2})


def test_stored_search_equals_the_unstored(spark, sf, tmp_path):
    want = [tuple(r) for r in QUERIES["semantic_search_dedup"](spark, sf).collect()]
    assert [tuple(r) for r in QUERIES["semantic_search_by_bucket"](spark, sf).collect()] == want
    owners = spark.createDataFrame([(i, f"o{i % 20}", i % 7, [float(i), 1.0]) for i in range(2000)], "id int, user_id string, document_id int, embedding array<double>")
    stored = BucketedTable(spark, str(tmp_path / "c"), "user_id", 32).create(owners)
    found = search.semantic_search_stored(stored, "o3", [1.0, 0.0], 5)
    assert found.count() == 5 and rows_read(search.semantic_search_stored(stored, "o3", [1.0, 0.0], 5)) <= 400
    assert "ArrowEvalPython" not in plan(found)


def test_index_recall_and_rows_read(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    at = [(r.vec_id, np.array(r.embedding, np.float64)) for r in rows.collect()]
    ids, x = np.array([i for i, _ in at]), np.stack([v for _, v in at])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got: dict[int, set] = {}
    for r in QUERIES["vector_index_search"](spark, d).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[q] & set(ids[np.lexsort((ids, -(x @ x[list(ids).index(q)])))[:10]])) / 10 for q in sorted(got)]
    assert len(got) == 20 and np.mean(hits) >= 0.9


def test_index_reads_its_cells_and_takes_upkeep(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 3
    x = centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16))
    rows = [(i, "k", v.tolist(), 5) for i, v in enumerate(x)] + [(9000, "k", None, 5), (9001, "k", [0.0] * 16, 5), (9002, "k", [float("nan")] * 16, 5), (9003, "k", [1.0] * 3, 5)]
    schema = "vec_id int, kind string, embedding array<double>, cells int"
    VectorIndex.build(spark.createDataFrame(rows[:1500] + rows[2000:], schema), str(tmp_path / "i"), "vec_id")
    index = VectorIndex.open(spark, str(tmp_path / "i"))
    assert index.rows().select("vec_id").distinct().count() == 1500 and index.rows().count() == 3000
    index.append(spark.createDataFrame(rows[1500:2000], schema))
    q = x[1700].tolist()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = [int(i) for i in np.argsort(-(unit @ unit[1700]), kind="stable")[:10]]
    found = index.search(q, 10, probes=8)
    assert len({r.vec_id for r in found.collect()} & set(exact)) >= 9
    assert rows_read(index.search(q, 10, probes=8)) < index.rows().count() / 3
    assert "cell" in plan(found).split("PartitionFilters: [")[1].split("]")[0]
    assert [r.vec_id for r in index.search(q, 10, probes=len(index.centres)).collect()] == exact

    before = files(index.path)
    index.delete(spark.createDataFrame([(exact[0],), (exact[1],), (-5,)], "id int"))
    changed = [c for c in before if files(index.path).get(c) != before[c]]
    assert 1 <= len(changed) <= 2 * index.copies and all(c.startswith("cell=") for c in changed)
    left = index.search(q, 8, probes=len(index.centres)).collect()
    assert [r.vec_id for r in left] == exact[2:] and left[0].kind == "k"
    index.delete(index.rows().select("vec_id"))
    assert not [f for f in files(index.path) if f.startswith("cell=")]


def test_an_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([(1, None)], "vec_id int, embedding array<double>")
    index = VectorIndex.build(empty, str(tmp_path / "i"), "vec_id")
    assert len(index.centres) == 0


def test_requests_are_bounded_and_of_similar_lengths():
    texts = ["x" * n for n in (5, 1, 30, 2, 100, 3, 4)]
    cut = list(embedding.requests(texts, most_texts=3, budget=50))
    assert sorted(i for c in cut for i in c) == list(range(7)) and all(len(c) <= 3 for c in cut)
    assert all(sum(len(texts[i]) for i in c) <= 50 or len(c) == 1 for c in cut)
    assert [len(texts[i]) for c in cut for i in c] == sorted(map(len, texts))


def test_a_failing_model_leaves_rows_with_errors(spark, tmp_path):
    good = embedding.hashing_embedder(4)

    def model(texts):
        for t in texts:
            with open(tmp_path / f"{abs(hash(t))}", "a") as log:
                log.write("x")
        if any("poison" in t for t in texts):
            raise RuntimeError("cannot read this")
        return good(texts)

    rows = [(1, "a b"), (2, "a b"), (3, "poison"), (4, ""), (5, None), (6, "y" * 20_001), (7, "c"), (8, "kept")]
    df = spark.createDataFrame([(i, t, [1.0] * 4 if t == "kept" else None) for i, t in rows], "id int, content string, embedding array<float>").coalesce(1)
    got = {r.id: r for r in embedding.embed_rows(df, "content", model, 4, attempts=2, pause=0.0).collect()}
    assert len(got) == 8
    assert got[1].embedding == got[2].embedding == pytest.approx(good(["a b"])[0].tolist()) and got[7].embedding is not None
    assert got[3].embedding is None and got[3].embed_error == "RuntimeError: cannot read this"
    assert got[4].embed_error == "a text is empty" and "20000" in got[6].embed_error
    assert got[5].embed_error is None and got[5].embedding is None and got[8].embedding == [1.0] * 4 and got[8].embed_error is None
    calls = {r.content: r.calls for r in embedding.dispatch(df, "content", model, 4, attempts=2, pause=0.0).collect()}
    assert calls["poison"] >= 4 and calls[""] == 0  # with others, and alone


def test_retry_and_timeout():
    tried: list[int] = []

    def shaky(texts):
        tried.append(len(texts))
        if len(tried) < 3:
            raise OSError("busy")
        return np.ones((len(texts), 2), np.float32)

    assert [(e, n) for _, e, n in embedding.answer(shaky, ["a", "b"], attempts=3, pause=0.0)] == [(None, 3)] * 2 and tried == [2, 2, 2]
    stop = threading.Event()

    def hanging(texts):
        if "slow" in texts:
            stop.wait(30)
        return np.ones((len(texts), 2), np.float32)

    found = embedding.answer(hanging, ["slow", "quick"], attempts=1, timeout=0.2, pause=0.0)
    stop.set()
    assert "TimeoutError" in found[0][1] and found[1][1] is None


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id int, content string, embedding array<float>")
    assert embedding.embed_rows(none, "content", embedding.hashing_embedder(4), 4).count() == 0

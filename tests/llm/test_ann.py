from __future__ import annotations

import numpy as np
import pytest

from codexframe.llm import ann


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        row = ids.index(q)
        scores = [(-float(x[row] @ x[i]), ids[i]) for i in range(len(ids)) if i != row]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def test_recall_over_learned_partitions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = ann.nearest(df, "id % 20 = 0", k=20, sample=3000).collect()
    want = exact(list(range(4000)), x.astype(np.float64), range(0, 4000, 20), 20)
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert all(a.score > b.score or (a.score == b.score and a.id < b.id) for a, b in zip(found, found[1:]))
        assert all(abs(r.score - float(x[q].astype(float) @ x[r.id].astype(float))) < 1e-12 for r in found)
        hits += len({r.id for r in found} & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_query_recall(spark, scale):
    """The registered query, by its default parameters, over several parts."""
    from codexframe.llm.queries import op1_learned_partitions

    d = f"/root/testdata/{scale}"
    rows = op1_learned_partitions(spark, d).collect()
    data = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    assert ann.part_count(len(data)) > 4
    x = np.array([r.embedding for r in data], np.float64)
    ids = [r.vec_id for r in data]
    want = exact(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in v}) for q, v in want.items()) / sum(map(len, want.values())) >= 0.9


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_when_parts_are_cut_again(spark, clusters, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    if clusters:
        x = 3 * rng.normal(size=(clusters, 16))[rng.integers(0, clusters, 3000)] + 0.5 * x
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    cut = []
    real = ann._part_routers
    monkeypatch.setattr(ann, "_part_routers", lambda *a: cut.append(real(*a)) or cut[-1])
    monkeypatch.setattr(ann, "discard", lambda *a: None)
    rows = ann.nearest(df, "id % 20 = 0", k=20, rows_per_part=100, sample=2500).collect()
    made = [ann._unpickled(r.model).parts for r in cut[0].collect()]
    assert len(cut) == 1 and sum(made) > len(made) > 4
    want = exact(list(range(3000)), x, range(0, 3000, 20), 20)
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.id)
    assert sum(len(got[q] & {i for i, _ in v}) for q, v in want.items()) / sum(map(len, want.values())) >= 0.9


@pytest.mark.parametrize("block", [200])
def test_three_levels(spark, block, monkeypatch):
    """Parts of parts of parts, each by its own classifier, also where a part's rows meet it in several blocks."""
    rng = np.random.default_rng(5)
    x = 3 * rng.normal(size=(60, 16))[rng.integers(0, 60, 6000)] + 0.5 * rng.normal(size=(6000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    sizes, cuts = [], []
    real, far = ann._sizes, ann._route_far
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "_sizes", lambda rows: sizes.append(real(rows)) or sizes[-1])
    monkeypatch.setattr(ann, "_route_far", lambda *a: cuts.append(1) or far(*a))
    monkeypatch.setattr(ann, "discard", lambda *a: None)
    rows = ann.nearest(df, "id % 20 = 0", k=20, rows_per_part=120, most_parts=4, sample=5000).collect()
    base = [{r.part: r.n for r in s.collect()} for s in sizes[::2]]
    assert len(base) == 3 and len(cuts) == 2 and all(sum(b.values()) == 6000 for b in base)
    assert len(base[0]) == 4 < len(base[1]) <= 16 < len(base[2]) <= 64
    want = exact(list(range(6000)), x, range(0, 6000, 20), 20)
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r)
    assert all(sorted(r["rank"] for r in v) == list(range(1, 21)) for v in got.values())
    assert sum(len({r.id for r in got[q]} & {i for i, _ in v}) for q, v in want.items()) / sum(map(len, want.values())) >= 0.9


def test_levels_follow_the_rows():
    levels = lambda n: ann._levels(n, ann.part_count(n), ann.ROWS_PER_PART, ann.MOST_PARTS)
    assert [levels(n) for n in (0, 50, 51_282, 262_144, 262_200, 16_700_000, 17_000_000, 10**9, 2 * 10**9)] == [1, 1, 1, 1, 2, 2, 3, 3, 4]


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16)) * 4
    x = np.concatenate([c + rng.normal(size=(100, 16)) for c in centres])
    graph = ann.neighbour_graph(x, 10)
    part = ann.balanced_parts(graph, x, 8)
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() <= 105 and (part[graph] == part[:, None]).mean() > 0.8
    router = ann.train_router(x, 8)
    assert router.probabilities(x).shape == (800, 8)


def test_ties_copies_and_invalid_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100 + i, [0.0, 1.0]) for i in range(3)]
    rows += [(200, None), (201, [0.0, 0.0]), (202, [float("nan"), 1.0]), (203, [1.0, None]), (204, [1.0]), (205, [float("inf"), 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, "id % 20 = 0", k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert set(got) == {0, 20, 40, 100}
    assert [i for _, i, _ in sorted(got[40])] == list(range(20))  # ties to the smaller id
    assert [i for _, i, _ in sorted(got[0])] == list(range(1, 21))
    assert [i for _, i, _ in sorted(got[100])] == [101, 102, *range(18)]


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>, v int, id int, part int, class int, label int"
    few = spark.createDataFrame([(0, [1.0, 2.0], 1, 1, 1, 1, 1), (1, [2.0, 1.0], 1, 1, 1, 1, 1)], schema)
    assert [(r.query_id, r["rank"], r.id, r.score) for r in ann.nearest(few, "id % 20 = 0").collect()] == [(0, 1, 1, 4.0)]
    assert ann.nearest(spark.createDataFrame([], schema), "id % 20 = 0").count() == 0
    assert ann.nearest(spark.createDataFrame([(0, None, 1, 1, 1, 1, 1)], schema), "id % 20 = 0").count() == 0


def _plain(rows, query, k):
    """The list of one row ``(id, v)`` among the distinct other rows."""
    others = [(i, float(np.dot(query[1], v))) for i, v in {(i, tuple(v)) for i, v in rows} - {(query[0], tuple(query[1]))}]
    return sorted(others, key=lambda x: (-x[1], x[0]))[:k]


def test_repeated_rows_and_ids_with_several_vectors(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.integers(-9, 9, 4).astype(float).tolist()) for i in range(50)]
    rows += [(0, rows[0][1]), (20, rows[20][1]), (20, rows[20][1])]  # repeated rows
    rows += [(40, [1.0, 2.0, 3.0, 4.0]), (7, [4.0, 4.0, 4.0, 4.0]), (60, rows[20][1])]  # an id with two vectors, one vector with two ids
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 20 = 0", k=20).collect():
        got.setdefault((r.query_id, r["rank"]), []).append((r.id, r.score))
    want = {}
    for q in {(i, tuple(v)) for i, v in rows if i % 20 == 0}:
        for rank, found in enumerate(_plain(rows, q, 20), 1):
            want.setdefault((q[0], rank), []).append(found)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_one_vector_on_a_third_of_the_rows(spark):
    rng = np.random.default_rng(13)
    hot = [3.0, 0.0, 1.0, 0.0]
    rows = [(i, hot if i % 3 else (rng.normal(size=4) * 2).tolist()) for i in range(600)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 20 = 0", k=5, cover=1.1).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    assert len(got) == 30
    for q in range(0, 600, 20):
        assert [i for _, i in sorted(got[q])] == [i for i, _ in _plain(rows, rows[q], 5)]


def test_large_vectors_with_near_ties(spark):
    rng = np.random.default_rng(14)
    base = rng.normal(size=64) * 1e4
    x = base + rng.normal(size=(60, 64)) * 1e-9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.nearest(df, "id = 0", k=20).collect()
    want = sorted(range(1, 60), key=lambda i: (-(x[0] * x[i]).sum(), i))[:20]
    assert [r.id for r in sorted(rows, key=lambda r: r["rank"])] == want

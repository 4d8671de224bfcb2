from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from codexframe.llm.codes import build_tree, compress, decode, encode, fit, kept_vectors, nearest_entry
from codexframe.llm.oracles import ORACLES

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Every part against every entry, in Python integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[int(np.floor(x * scale)) for x in r[1]] for r in rows]
    width = len(whole[0]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in whole[:entries]] for p in range(parts)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))
    near = lambda x, book: min((far(x, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for v in whole:
                mine[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(mine[i]) for c in zip(*mine[i])] if i in mine else e for i, e in enumerate(books[p])]
    found = [[near(cut(v, p), books[p]) for p in range(parts)] for v in whole]
    errors = defaultdict(int)
    for r, f in zip(rows, found):
        errors[r[2]] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f), errors[r[2]], digest) for r, f in zip(rows, found)]


def answers(found):
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    return sorted((tuple(r[c] for c in ("id", "code", "error", "label_error", "codebooks_sha256")) for r in found.collect()), key=key)


@pytest.mark.parametrize("n, spread", [(0, 5), (1, 5), (4, 5), (40, 2), (200, 3), (256, 1000), (256, 10**12)])
def test_tree_finds_the_smallest_nearest(n, spread):
    draw = np.random.default_rng(n + spread)
    kind = object if spread > 10**9 else np.int64
    entries = draw.integers(-spread, spread, (max(n, 1), 4)).astype(kind)  # narrow spreads are full of ties and repeats
    x = draw.integers(-2 * spread, 2 * spread, (3000, 4)).astype(kind)
    index, far = nearest_entry(x, entries, build_tree(entries))
    every = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert (far == every.min(1)).all() and (index == every.argmin(1)).all()


def test_equals_plain_arithmetic(spark):
    draw = random.Random(5)
    rows = [(i, [round(draw.gauss(0, 1), draw.choice((1, 5))) for _ in range(16)], draw.choice((None, 1, 2))) for i in range(300)]
    rows += [(i, rows[0][1], 1) for i in range(300, 400)]  # one vector on a quarter of the rows
    rows += [(500, None, 1), (501, [float("nan")] * 16, 1), (502, [float("inf")] + [0.0] * 15, 1), (503, [None] + [0.0] * 15, 2), (None, [0.5] * 16, None)]
    got = answers(compress(spark.createDataFrame(rows, SCHEMA)))
    assert got == sorted(by_plain(rows), key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


def test_values_beyond_64_bit_squares(spark):
    draw = random.Random(6)
    rows = [(i, [draw.choice((1e9, -3e8, 0.1)) * draw.random() for _ in range(8)], i % 2) for i in range(60)]
    got = compress(spark.createDataFrame(rows, SCHEMA), rounds=3)
    want = by_plain(rows, rounds=3)
    assert [r[1] for r in answers(got)] == [r[1] for r in want] and [r[4] for r in answers(got)] == [r[4] for r in want]
    assert [r[2] for r in answers(got)] == [r[2] if r[2] < 1 << 63 else None for r in want]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA + ", key string, id string, v int, code string, n int, error int")
    assert compress(empty).collect() == []
    assert compress(spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1), (3, [], 1)], SCHEMA)).collect() == []
    rows = [(1, [1.0] * 10, 1), (1, [1.0] * 10, 1), (2, [0.0] * 10, None), (3, [5.0] * 9, 1), (4, [-2.5] * 10, 7)]
    odd = spark.createDataFrame([(*r, "k", "i", 2, "c", 5, 6) for r in rows], SCHEMA + ", key string, id string, v int, code string, n int, error int")
    got = compress(odd).collect()
    assert sorted(r["id"] for r in got) == [1, 1, 2, 4]  # another length than most
    assert all(r["error"] == 0 and len(r["code"]) == 16 for r in got)
    assert [r["code"] for r in got if r["id"] == 1] == ["00" * 8] * 2  # ties to the lower of two equal entries


def test_codes_give_near_vectors_back(spark):
    draw = random.Random(8)
    centres = [[draw.uniform(-1, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [x + draw.gauss(0, 0.01) for x in centres[i % 12]], 0) for i in range(240)]
    vectors = kept_vectors(spark.createDataFrame(rows, SCHEMA))
    books = fit(vectors, rounds=4)
    back = {r["id"]: r["approximation"] for r in decode(encode(vectors, books), books).collect()}
    for i, v, _ in rows:
        assert len(back[i]) == 16 and max(abs(a - b) for a, b in zip(back[i], v)) < 0.2


def test_sql_says_the_same_of_ties_and_nulls(spark, tmp_path):
    draw = random.Random(9)
    rows = [(i, [draw.randint(-2, 2) / 4096 for _ in range(16)], draw.choice((None, 1, 2, 3))) for i in range(120)] + [(200, None, 1), (201, [float("nan")] * 16, 2)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    want = con.execute(ORACLES["op13_vantage_codes"])
    names = [d[0] for d in want.description]
    want = sorted(tuple(r[names.index(c)] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in want.fetchall())
    assert answers(compress(spark.createDataFrame(rows, SCHEMA))) == want

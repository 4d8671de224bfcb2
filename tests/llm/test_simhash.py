from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from codexframe.llm import common, simhash
from codexframe.llm.components import connected_components


def plain_fingerprint(text: str | None, k: int = 4) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_fingerprint_matches_the_definition():
    for text in ("", None, "one", "A b C", "a b c d e f g", "É Ünder\tdogs\nran \x0b far", "x " * 50):
        assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_links_are_all_close_pairs_once(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(150)]
    for v in list(values):
        for bits in range(1, 7):
            flips = rng.sample(range(64), bits)
            values.append(v ^ sum(1 << f for f in flips))
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    for most in (0, 4, 5):
        found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), most).collect()
        got = [(r.a, r.b) for r in found]
        assert len(got) == len(set(got))
        u = np.array(values, np.int64).view(np.uint64)
        near = np.bitwise_count(u[:, None] ^ u[None, :]) <= most
        want = {(values[i], values[j]) for i, j in zip(*np.nonzero(near)) if i < j}
        assert set(got) == want


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2200)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a long, b long")).collect()}
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    want = components([p for p in pairs if p[0] != p[1]], nodes)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_brute_force(spark, sf):
    from codexframe.llm.queries import op8_simhash

    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in op8_simhash(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    ids = sorted(texts)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = components(pairs, ids)
    assert got == {i: (fps[i], want[i]) for i in ids}


def test_odd_rows(odd, none):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append((r.fp, r.component_id))
    assert len(by[1]) == 2 and len({c for _, c in by[1] + by[2]}) == 1 and by[2][0][1] == 1
    assert by[3][0] == (0, 3) and by[4][0] == (0, 3) and by[5][0] == (0, 3)  # no words: one class, smallest id
    assert (0, 3) in by[None]
    assert simhash.simhash_components(none).count() == 0


def test_keep_one_leaves_one_of_each_group(spark, odd, none):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(300)] for _ in range(40)]
    rows, group = [], {}
    for g, words in enumerate(base):
        for copy in range(rng.choice((1, 2, 5))):
            edited = list(words)
            if copy:
                for at in rng.sample(range(300), 2):  # 2 words of 300 in 5-word shingles: similarity about 0.93
                    edited[at] = rng.choice(vocabulary)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(edited)))
    kept = [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(group[i] for i in kept) == list(range(40))
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    assert set(kept) == set(first.values())
    left = simhash.keep_one(odd)
    assert left.columns == odd.columns and left.where("doc_id = 1").count() == 1 and left.where("doc_id = 2").count() == 0
    assert left.where("coalesce(trim(replace(replace(text, '\n', ' '), '\t', ' ')), '') = ''").count() == 1
    assert simhash.keep_one(none).count() == 0


def classes_of(spark, texts: list[str]) -> dict[int, int]:
    """The smallest position of each text's class."""
    rows = spark.createDataFrame(list(enumerate(texts)), "uid long, text string").select("uid", "text", *simhash.text_key(F.col("text")))
    found = rows.select("uid", "ka", "kb").join(simhash.similar_classes(rows), ["ka", "kb"]).collect()
    least: dict[int, int] = {}
    for r in found:
        least[r.label] = min(r.uid, least.get(r.label, r.uid))
    return {r.uid: least[r.label] for r in found}


def test_similar_classes_lose_no_link(spark):
    """Against all pairs: classes are the components over Jaccard 0.8, none lost."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(500)]
    texts = []
    for _ in range(6):
        words = [rng.choice(vocabulary) for _ in range(200)]
        for _ in range(25):  # a dense group around one text
            edited = list(words)
            for at in rng.sample(range(200), rng.choice((1, 2, 3, 4))):
                edited[at] = rng.choice(vocabulary)
            texts.append(" ".join(edited))
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    pairs = [
        (a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))
        if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    ]
    want = components(pairs, range(len(texts)))
    assert classes_of(spark, texts) == want


def test_the_index_join_is_an_equality_join(spark, sf):
    plan = simhash.links(simhash.fingerprints(spark.read.parquet(f"{sf}/documents.parquet")))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_classes_equal_all_pairs_in_short_texts_of_groups_of_two(spark):
    """Against all pairs, without any loss: texts of 30 to 120 words with one or two words replaced."""
    rng = random.Random(21)
    vocabulary, texts = [f"v{i}" for i in range(2000)], []
    passage = " ".join(rng.choice(vocabulary) for _ in range(25))  # in every third pair: common shingles
    for n in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))]
        edited = list(words)
        for at in rng.sample(range(len(words)), rng.choice((1, 1, 2))):
            edited[at] = rng.choice(vocabulary)
        texts += [f"{passage} {' '.join(x)}" if n % 3 == 0 else " ".join(x) for x in (words, edited)]
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    pairs = [
        (a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))
        if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    ]
    assert len(pairs) > 100
    assert classes_of(spark, texts) == components(pairs, range(len(texts)))


def test_completion_finds_what_fingerprints_miss(spark, monkeypatch):
    """Cross pairs alone, without any candidate from fingerprints or central texts, still find every link."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 90))]
        for _ in range(4):
            edited = list(words)
            for at in rng.sample(range(len(words)), rng.choice((0, 1, 2))):
                edited[at] = rng.choice(vocabulary)
            texts.append(" ".join(edited).upper() if rng.random() < 0.2 else " ".join(edited))
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    pairs = [
        (a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))
        if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    ]
    want = components(pairs, range(len(texts)))
    assert classes_of(spark, texts) == want
    nothing = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "leader_links", lambda *_: nothing)
    monkeypatch.setattr(simhash, "central_pairs", lambda *_: nothing)
    assert classes_of(spark, texts) == want


def test_leader_links_are_all_links_outside_of_crowds(spark, monkeypatch):
    rng = random.Random(2)
    values = [rng.getrandbits(63) for _ in range(60)]
    values += [v ^ sum(1 << f for f in rng.sample(range(63), bits)) for v in values for bits in (1, 3, 5)]
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    pair = lambda rows: sorted((min(r.a, r.b), max(r.a, r.b)) for r in rows.collect())
    every = pair(simhash.links(fps, 5))
    assert pair(simhash.leader_links(fps)) == every and every
    monkeypatch.setattr(simhash, "LEADERS", 1)
    assert set(pair(simhash.leader_links(fps))) < set(every)


def test_a_kept_row_of_repeated_ones_and_of_clashing_names(spark):
    rows = [(1, "a b c", 5, 6, 7)] * 3 + [(1, "other text here", 5, 6, 7), (None, "A  B c", 5, 6, 7), (2, "q", 5, 6, 8), (2, "q", 5, 6, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ka int, `row` int, n int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c"), (1, "other text here"), (2, "q")]


def test_heavy_join_is_a_plain_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 4)
    rows = spark.createDataFrame([(i, i % 3 if i < 60 else i) for i in range(90)], "id int, k int")
    by_key = rows.groupBy("k").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    keys = by_key.drop("n")
    assert sorted(common.heavy_join(rows, by_key, ["k"]).select("id", "k", "low").collect()) == sorted(rows.join(keys, "k").select("id", "k", "low").collect())
    assert common.heavy_join(rows.limit(0), by_key.limit(0), ["k"]).count() == 0


def test_scratch_tables_leave_no_setting_and_read_the_same(spark):
    from codexframe.llm.common import REMOVE_SHUFFLES, discard, materialize

    before = spark.conf.get(REMOVE_SHUFFLES, "false")
    counts = spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count()
    held = materialize(counts, "counts")
    assert spark.conf.get(REMOVE_SHUFFLES, "false") == before
    assert sorted(held.collect()) == sorted(counts.collect())  # a plan whose shuffle files went is worked out anew
    discard(held)

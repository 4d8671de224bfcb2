from __future__ import annotations

import itertools
import re
from collections import Counter

import pytest

import corpus_pipeline


def test_stages_and_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_over_the_small_table(spark, sf):
    from codexframe.llm.common import materialize

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), name)
        seen.append(docs)
    given, good, clean, single, mixed, packed = seen
    assert all(x.columns == columns for x in (good, clean, single, mixed))
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    long = {r.doc_id for r in given.collect() if r.text and len(r.text.split()) >= 50}
    assert not any(quality.get(i) == 0 for i in kept)
    assert all(i in kept for i in long if quality.get(i) == 1 and i not in _repetitive(given))
    assert {r.doc_id for r in clean.collect()} == kept and all(r.n_chars == len(r.text) for r in clean.collect())
    texts = [r.text for r in single.collect()]
    assert len(texts) == len({" ".join(t.lower().split()) for t in texts})
    sizes = {r.doc_id: len(r.text.split()) for r in single.collect()}
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= set(sizes) and max(times.values()) <= 3
    total = sum(sizes[i] * n for i, n in times.items())
    assert abs(total - sum(sizes.values())) <= 20 * max(sizes.values())
    places = {}
    for r in packed.collect():
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(n for _, n in p) <= 1024
    pieces = Counter(r.doc_id for r in packed.where("piece = 0").collect())
    assert pieces == times


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _similar(a, b):
    if min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
        return False
    return len(a & b) >= 0.8 * len(a | b)  # two texts without words are alike


def _kept_by_all_pairs(rows):
    """Smallest id of each component of texts of similarity 0.8 or more, every pair compared."""
    sets = {r.doc_id: _shingles(r.text) for r in rows}
    ids, low = sorted(sets), {}
    top = lambda x: x if low.get(x, x) == x else top(low[x])
    for a, b in itertools.combinations(ids, 2):
        if top(a) != top(b) and _similar(sets[a], sets[b]):
            x, y = sorted((top(a), top(b)))
            low[y] = x
    return {top(i) for i in ids}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_near_dedup_keeps_what_all_pairs_say(spark, scale):
    from codexframe.llm.common import materialize

    d = f"/root/testdata/{scale}"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean = materialize(corpus_pipeline.line_dedup(spark, materialize(corpus_pipeline.quality_rules(spark, docs, d), "good"), d), "clean")
    for given in (docs, clean):
        rows = given.select("doc_id", "text").collect()
        want = _kept_by_all_pairs(rows)
        got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, given, d).select("doc_id").collect()]
        assert sorted(got) == sorted(want) and len(want) < len(rows)


def test_run_drops_the_tables_of_finished_stages(spark, sf, monkeypatch):
    seen = []
    real = corpus_pipeline.discard
    monkeypatch.setattr(corpus_pipeline, "discard", lambda df: seen.append(df.scratch_path) or real(df))
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in seen] == [n for n, _ in corpus_pipeline.STAGES[:3]]


def _repetitive(docs):
    out = set()
    for r in docs.collect():
        words = (r.text or "").split()
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {p for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for p in (i, i + 1, i + 2)}
        if 2 * len(covered) > len(words):
            out.add(r.doc_id)
    return out


def test_stages_over_odd_and_empty_tables(spark, odd, none, sf):
    for docs in (odd, none):
        columns = docs.columns
        for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, sf)
            assert at == 4 or docs.columns == columns
        assert docs.count() >= 0
    assert corpus_pipeline.near_dedup(spark, odd, sf).count() == 8


def test_mixing_keeps_two_copies_of_a_repeated_row(spark, odd, sf):
    assert corpus_pipeline.mix_sources(spark, odd, sf).where("doc_id = 1").count() % 2 == 0

from __future__ import annotations

from collections import Counter

from codexframe.llm import langid


def plain_grams(text: str) -> Counter:
    letters = "".join(c.lower() if c.isalpha() else " " for c in text)
    joined = f" {' '.join(letters.split())} "
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(joined) - n + 1):
            g = joined[i : i + n]
            if g != " " and " " not in g[1:-1]:
                out[g] += 1
    return out


def test_counts_match_the_definition():
    table = langid._letter_table()
    for text in ("Hello, wörld! HELLO", "a", "日本 語", "x1y", " -- "):
        grams, counts = langid.gram_counts(text, table)
        decode = lambda g: "".join(chr(g >> s & (1 << 21) - 1) for s in (42, 21, 0) if g >> s & (1 << 21) - 1)
        got = {decode(int(g)): int(n) for g, n in zip(grams, counts)}
        want = plain_grams(text) if any(c.isalpha() for c in text) else {}
        assert got == dict(want), text


def test_out_of_place_distance(spark):
    rows = [(1, "aaa bbb aaa", "x"), (2, "ccc ddd", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn(docs)
    ranks = {}
    for r in profiles.collect():
        ranks.setdefault(r.lang, {})[r.gram] = r.rank
    top = langid._top(*langid.gram_counts("aaa ccc", langid._letter_table()), langid.PROFILE)
    want = {lang: sum(abs(p[g] - i) if g in p else langid.PROFILE for i, g in enumerate(top.tolist())) for lang, p in ranks.items()}
    got = langid.identify(spark.createDataFrame([(9, "aaa ccc")], "doc_id long, text string"), profiles).first()
    assert got.lang_pred == min(sorted(want), key=want.get) and 0 <= got.score <= 1


def _code(gram: str) -> int:
    return sum(ord(c) << 21 * i for i, c in enumerate(reversed(gram)))


def _most_frequent(counts: Counter) -> list[str]:
    return sorted(counts, key=lambda g: (-counts[g], _code(g)))[: langid.PROFILE]


def test_query_equals_plain_profiles(spark, sf):
    """Every document's language and score against profiles and distances worked out one n-gram after the other."""
    import math
    import zlib

    from codexframe.llm.queries import op3_rank_order_language

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    totals: dict[str, Counter] = {}
    for r in docs:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            totals.setdefault(r.lang, Counter()).update(plain_grams(r.text) if any(map(str.isalpha, r.text)) else {})
    ranks = {lang: {g: i for i, g in enumerate(_most_frequent(c))} for lang, c in totals.items()}
    got = {r.doc_id: r for r in op3_rank_order_language(spark, sf).collect()}
    assert len(got) == len(docs) > 100
    for r in docs:
        own = _most_frequent(plain_grams(r.text)) if r.text and any(map(str.isalpha, r.text)) else []
        if not own:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        far = {lang: sum(abs(p[g] - i) if g in p else langid.PROFILE for i, g in enumerate(own)) for lang, p in sorted(ranks.items())}
        best = min(far, key=far.get)  # the first by name of those that tie
        weights = [math.exp((far[best] - x) / (langid.PROFILE * len(own)) / 0.05) for x in far.values()]
        assert got[r.doc_id].lang_pred == best and abs(got[r.doc_id].score - 1 / sum(weights)) < 1e-9


def test_held_out_accuracy(spark):
    from codexframe.llm.queries import op3_rank_order_language

    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op3_rank_order_language(spark, d).collect()
    assert len(rows) == len(truth)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_odd_rows(odd, none):
    profiles = langid.learn(odd)
    assert {r.lang for r in profiles.select("lang").distinct().collect()} == {"en", "de", "xx"}
    rows = {}
    for r in langid.identify(odd, profiles).collect():
        rows.setdefault(r.id, []).append(r)
    assert [rows[i][0].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and rows[9][0].lang_pred == "xx"
    assert sum(map(len, rows.values())) == odd.count()
    nothing = langid.learn(none)
    assert nothing.count() == 0 and langid.identify(none, profiles).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}

from __future__ import annotations

import random
import re

from codexframe.llm import quality

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words),
    }


def test_counts_against_brute_force(spark):
    rng = random.Random(7)
    texts = [None, "", " \n ", "a b c a b c", "a a a a", "x\n\nx\n x\ny", "# * $ %%", " nbsp is a char\x0bvt"]
    for _ in range(60):
        texts.append(" ".join(rng.choice(("a", "b", "the", "c\n", "dd|")) for _ in range(rng.randrange(90))))
    rows = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.id])
        assert {k: r[k] for k in want} == want, texts[r.id]
        assert not (r.base_failed and r.kept)


def test_verdicts_and_rules(spark):
    rng = random.Random(8)
    good = " ".join(rng.choice(("the", "of", "and", "to", "house", "river", "stone", "walked", "evening", "paper", "quiet", "garden")) for _ in range(120))
    spam = " ".join(f"buy{i}### now{i}$$$" for i in range(60))
    rows = {r.id: r for r in quality.score(spark.createDataFrame([(1, good), (2, spam)], "doc_id long, text string")).collect()}
    assert rows[1].kept or rows[1].failed_rules == ["repeated_words"]
    assert not rows[2].kept and "symbols_per_word" in rows[2].failed_rules
    own = (quality.Rule("short", "n_words", high=10),)
    assert not quality.score(spark.createDataFrame([(1, good)], "doc_id long, text string"), rules=own).first().kept


def test_one_projection_without_functions_in_python(spark, sf):
    plan = quality.score(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_odd_rows(odd, none):
    rows = quality.score(odd).collect()
    assert len(rows) == odd.count()
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.where("text is null").count() == 0
    assert quality.score(none).count() == 0 and quality.keep_good(none).count() == 0

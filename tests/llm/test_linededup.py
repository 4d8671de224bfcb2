from __future__ import annotations

from collections import Counter

import pytest

from codexframe.llm import linededup


def plain(rows, ratio, least):
    total, pages = Counter(), Counter()
    for _, host, text in rows:
        if host is not None:
            total[host] += 1
            pages.update({(host, x.strip(" \t\n\x0b\x0c\r")) for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")})
    bad = {k for k, n in pages.items() if n >= least and n / total[k[0]] > ratio}
    out = []
    for key, host, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (host, x.strip(" \t\n\x0b\x0c\r")) not in bad]
        out.append((key, text if len(kept) == len(lines) else "\n".join(kept), len(lines) - len(kept)))
    return out


@pytest.fixture(scope="module")
def pages():
    rows = []
    for i in range(60):
        host = ("big", "big", "small", None)[i % 4]
        lines = [f"own {i}", " menu \t" if i % 3 else "Menu", "", "footer" if host == "big" else f"foot {i}", f"own {i}"]
        rows.append((i, host, "\n".join(lines)))
    return [*rows, (100, "small", None), (101, "small", ""), (102, "big", " footer")]


@pytest.mark.parametrize("bound", [linededup.SENT_ROWS, -1])
def test_against_brute_force_on_both_paths(spark, pages, bound, monkeypatch):
    monkeypatch.setattr(linededup, "SENT_ROWS", bound)
    df = spark.createDataFrame(pages, "doc_id long, source string, text string")
    got = linededup.drop_boilerplate(df, ratio=0.3, min_pages=3, salts=3, count_col="n").collect()
    assert sorted((r.doc_id, r.text, r.n) for r in got) == sorted(plain(pages, 0.3, 3))


def test_odd_rows(odd, none):
    out = linededup.drop_boilerplate(odd, ratio=0.5, min_pages=2)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("doc_id is null and text is not null").first().text == "no id but some words here"
    assert out.where("doc_id = 3").first().text is None
    assert linededup.drop_boilerplate(none).count() == 0


@pytest.mark.parametrize("bound", [linededup.SENT_ROWS, -1])
def test_columns_of_clashing_names_stay(spark, bound, monkeypatch):
    monkeypatch.setattr(linededup, "SENT_ROWS", bound)
    rows = [(i, f"own {i}\nmenu", "h", "q", "r", 1, 2, 3, 4) for i in range(9)]
    names = "doc_id long, text string, source string, __kept string, __host string, `row` int, lines int, salt int, host int"
    out = linededup.drop_boilerplate(spark.createDataFrame(rows, names), ratio=0.5, count_col="n")
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(i, f"own {i}", "h", "q", "r", 1, 2, 3, 4, 1) for i in range(9)] and out.columns[:-1] == [c.split()[0].strip("`") for c in names.split(", ")]

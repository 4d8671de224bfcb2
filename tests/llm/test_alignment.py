from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from codexframe.llm.alignment import align, group_products, groups, pair_counts, tokenizer_pair
from codexframe.llm.queries import queries
from codexframe.llm.tokencount import byte_chars, public_file

ODD = [
    "plain words here", "", None, " \n\t ", "日本語 \U0001f600 é ü ß ſ", "a ▁ b", "<|endoftext|> and <s> <unk> <0x41>", "nul \0 in it",
    "x" * 3000, "  two  spaces   three ", "don't won't 12345 ²³   \u0085", "plain words here", "é ‍ ﻿",
]


class Plain:
    """Token bytes and links the slow way: every token of one side against every token of the other."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_file("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.names = {i: t for t, i in self.a.get_vocab().items()}
        self.byte_of = {c: b for b, c in enumerate(byte_chars())}
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_file("piece_bpe_32k.model"))

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.byte_of[c] for c in self.names[i])) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            byte = re.fullmatch("<0x(..)>", piece)
            b.append((i, bytes.fromhex(byte[1]) if byte else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    def spans(self, side):
        out, at = [], 0
        for i, x in side:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    def document(self, text):
        a, b = map(self.spans, self.tokens(text))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        shared = sorted({x[2] for x in a} & {y[2] for y in b})
        cut, last = [], 0
        for end in shared:
            cut.append(tuple(",".join(str(t[0]) for t in side if last < t[2] <= end) for side in (a, b)))
            last = end
        return len(a), len(b), cut, links


def by_plain(texts):
    plain = Plain()
    found = [plain.document(t) for t in texts]
    counts = Counter(link for f in found for link in f[3])
    most: dict[int, int] = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    rows = []
    for n_a, n_b, cut, links in found:
        digest = hashlib.sha256(";".join("|".join(g) for g in cut).encode()).hexdigest() if n_a else ""
        best = sum(counts[x] == most[x[1]] for x in links)
        rows.append((n_a, n_b, len(cut), len(links), best, sum(counts[x] for x in links), digest))
    return rows, counts, most


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_equals_plain_alignment(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500 or text is null").limit(120)  # the plain way is quadratic
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet")).collect()
    want, _, _ = by_plain([r["text"] for r in rows])
    got = queries()["op11_elementary_intervals"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got) == sorted((r["doc_id"], *w) for r, w in zip(rows, want))


def test_both_engines_give_the_same_ids():
    both, plain = tokenizer_pair(public_file("byte_bpe_50k.json"), public_file("piece_bpe_32k.model")), Plain()
    draw = random.Random(4)
    pool = [chr(i) for i in range(256)] + [" the", "'s", "  ", "\n\n", "<|endoftext|>", "12", "\u0085", "\x1c", "zqxj"] * 10
    for _ in range(3000):
        text = " " + "".join(draw.choice(pool) for _ in range(draw.randint(0, 30)))
        assert both.ids_a(text) == plain.a.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("block_links", [1, 50, 1 << 20])
def test_blocks_of_any_size_and_odd_texts(spark, block_links):
    draw = random.Random(3)
    texts = ODD + ["".join(draw.choice("ab é1\n<|>▁日") for _ in range(draw.randint(1, 60))) for _ in range(60)]
    texts += ["plain words here"] * 40  # one group of copies
    want, counts, most = by_plain(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(3)
    got = align(rows, "n", "text", block_links=block_links).collect()
    assert [(r["id"], *(r[c] for c in COLUMNS)) for r in sorted(got, key=lambda r: r["id"])] == [(n, *w) for n, w in enumerate(want)]
    met = pair_counts(rows, "n", "text", block_links=block_links).collect()
    assert {(r["a"], r["b"]): r["count"] for r in met} == counts
    assert all(r["best"] == (r["count"] == most[r["b"]]) for r in met)


def test_groups_and_their_products(spark):
    plain = Plain()
    rows = spark.createDataFrame(list(enumerate(ODD)), "n int, text string")
    found = groups(rows, "n", "text")
    got = sorted(found.collect(), key=lambda r: (r["id"], r["group"]))
    want = [(n, *g) for n, t in enumerate(ODD) for g in plain.document(t)[2]]
    assert [(r["id"], ",".join(map(str, r["a_ids"])), ",".join(map(str, r["b_ids"]))) for r in got] == want
    for r in got:
        assert r["start"] < r["end"] and (r["group"] > 0 or r["start"] == 0)
    products = Counter(r["id"] for r in group_products(found).collect())
    assert products == Counter({r["id"]: r["n_products"] for r in align(rows, "n", "text").collect() if r["n_products"]})


def test_odd_rows_and_empty_tables(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    got = align(odd).collect()
    assert len(got) == len(rows)
    empty = [r for r in got if r["n_a"] == 0]
    assert len(empty) == 3 and all(tuple(r[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "") for r in empty)
    assert align(none).count() == 0 and pair_counts(none).count() == 0 and groups(none).count() == 0

from __future__ import annotations

import random

import pytest
from tokenizers import Tokenizer

from codexframe.llm import tokencount
from codexframe.llm.queries import queries
from codexframe.llm.tokencount import Counter, count_tokens, has_shortcut, load_tokenizer, public_file, whole_tokens

PATH = public_file()


@pytest.fixture(scope="module")
def whole():
    return whole_tokens(PATH)


def by_library(text: str | None) -> int:
    return len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


def test_whole_tokens_are_proved(whole):
    own = Tokenizer.from_file(PATH)
    assert len(whole) > 45_000 and "<|endoftext|>" not in whole
    for text in random.Random(1).sample(sorted(whole), 2000):
        pieces = own.pre_tokenizer.pre_tokenize_str(text)
        if len(pieces) == 1:  # a string of several pre-tokens never is one
            assert len(own.encode(text).ids) == 1


def test_counts_are_those_of_the_library(whole):
    own, count = load_tokenizer(PATH), Counter(PATH, whole).count
    draw = random.Random(7)
    alphabet = [chr(i) for i in range(256)] + ["İ", " ", "　", "\U0001f600", "é", "日", "ſ", "İ", "​", "٣", "²"] * 3
    parts = [" the", "'s", "'ll", "  ", "\n\n", " 123", "!!", "<|endoftext|>", "<|endof", "zqxj", "\x85", "\xa0", "\x1c", "don't", " — "]
    for n in range(4000):
        pool = parts if n % 3 else alphabet + parts
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 30)))
        assert count(text)[0] == len(own.encode(text, add_special_tokens=False).ids), repr(text)


def test_latin_pieces_are_those_of_the_library(whole):
    own, counter = load_tokenizer(PATH), Counter(PATH, whole)
    for a in map(chr, range(256)):
        for b in map(chr, range(256)):
            text = f"x{a}{b} 1"
            assert counter.pieces(text) == [text[i:j] for _, (i, j) in own.pre_tokenizer.pre_tokenize_str(text)], repr(text)


def test_query_equals_the_library(spark, sf):
    got = {r["doc_id"]: r for r in queries()["op12_whole_tokens"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    own = load_tokenizer(PATH)
    assert len(got) == len(docs)
    for d in docs:
        n, row = len(own.encode(d["text"] or "", add_special_tokens=False).ids), got[d["doc_id"]]
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len((d["text"] or "").encode()), n, n > 1024)
        assert row["n_whole"] <= row["n_pieces"] <= n
    assert sum(r["n_whole"] for r in got.values()) > 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_odd_rows_and_other_files(spark, odd, none, name):
    import sentencepiece

    path = public_file(name)
    if name.endswith(".json"):
        own = Tokenizer.from_file(path)
        own.no_truncation()
        size = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    else:
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lambda t: len(own.encode(t))
    assert has_shortcut(path) == (name == "byte_bpe_50k.json")
    rows = odd.select("doc_id", "text").collect()
    got = count_tokens(odd, path=path, limit=100).collect()
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()), size(r["text"] or "")) for r in rows))
    assert sorted((r["id"] is None, r["id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert count_tokens(none, path=path).count() == 0


def test_remembered_merges_are_bounded(whole, monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 10)
    counter = Counter(PATH, whole)
    text = " ".join(f"zq{i}xj" for i in range(500)) + " " + "y" * 5000
    assert counter.count(text)[0] == by_library(text) and len(counter.merged) <= 10

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from codexframe.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def best_fit_decreasing(sizes, capacity):
    gaps, bins = Counter(), 0
    for s in sorted(sizes, reverse=True):
        g = min((g for g in gaps if g >= s and gaps[g]), default=None)
        if g is None:
            bins, g = bins + 1, capacity
            gaps[g] += 1
        gaps[g] -= 1
        gaps[g - s] += 1
    return bins


def check(rows, docs, capacity, tokenizer):
    """Every token of every document in its place, exactly once."""
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.id, []).append(r)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    for key, text in docs.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[key], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        at = 0
        for p in pieces:
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
        assert all(p.length == capacity for p in pieces[1:]) and len(pieces) == -(-len(ids) // capacity)


def test_query_round_trip_and_count(spark, sf, tokenizer):
    from codexframe.llm.queries import op2_best_fit_packing

    rows = op2_best_fit_packing(spark, sf).withColumnRenamed("doc_id", "id").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(rows, docs, 1024, tokenizer)
    want = best_fit_decreasing([r.length for r in rows], 1024)
    assert len({r.sequence_id for r in rows}) <= 1.01 * want + 1


@pytest.mark.parametrize(
    "sizes",
    [
        [3] * 500,
        [64] * 33 + [1] * 5,
        [33, 33, 33],
        [random.Random(2).randrange(1, 64) for _ in range(700)],
        [random.Random(3).choice((1, 2, 40, 63)) for _ in range(600)],
        [],
    ],
)
def test_best_fit_is_as_good_as_the_sequential_one(spark, sizes):
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "item long, size long")
    rows = packing.best_fit(items, 64).collect()
    assert sorted(r.item for r in rows) == list(range(len(sizes)))
    used = Counter()
    for r in rows:
        used[r.bin] += r.size
    assert not used or max(used.values()) <= 64
    assert len(used) <= 1.05 * best_fit_decreasing(sizes, 64) + 1


def test_many_ranges_are_as_good(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_RANGE", 40)
    sizes = [random.Random(6).randrange(1, 64) for _ in range(400)]
    rows = packing.best_fit(spark.createDataFrame(list(enumerate(sizes)), "item long, size long"), 64).collect()
    used = Counter()
    for r in rows:
        used[r.bin] += r.size
    assert sorted(r.item for r in rows) == list(range(len(sizes))) and max(used.values()) <= 64
    assert len(used) <= 1.05 * best_fit_decreasing(sizes, 64) + 1


def test_left_overs_meet_by_rank():
    items, gaps, n = packing._resolve({0: (0, 2), 1: (1, 3), 2: (4, 0), 3: (2, 0)})
    assert n == 5  # five gaps above for seven items
    pair = lambda rows, part, o, sign: [shift + sign * o for p, a, b, shift in rows if p == part and a <= o < b]
    assert pair(items, 1, 0, 1) == pair(gaps, 0, 1, -1)  # the tightest gap above, last of range 0
    assert pair(items, 2, 0, 1) == pair(gaps, 1, 2, -1)
    assert pair(items, 2, 3, 1) == pair(gaps, 0, 0, -1)
    assert pair(items, 3, 0, 1) == []


def test_fast_engine_gives_the_tokenizer_ids(tokenizer):
    encode = packing.encoder(packing.tokenizer_path())
    rng = random.Random(4)
    alphabet = [chr(i) for i in range(256)] + list(" \n\t'sdtmrel 12.") * 8 + ["日", "ё", "\U0001f600", " "]
    for n in range(3000):
        text = "".join(rng.choice(alphabet if n % 2 else alphabet[:-4]) for _ in range(rng.randrange(1, 60)))
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids
    assert list(encode("a <|endoftext|> b")) == [64, 220, 50256, 275]
    for text in ("<|endoftext|>", "a<|endoftext|>b", "日<|endoftext|>本", "<|endoftext", " " * 5000, "a" * 20000, "\r\n\r\n"):
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_odd_rows(odd, none, tokenizer):
    rows = packing.pack_documents(odd, capacity=64).collect()
    assert sum(r.length for r in rows if r.id == 3) == 1 and sum(r.length for r in rows if r.id == 4) == 1
    assert len([r for r in rows if r.id == 1 and r.piece == 0]) == 2  # a repeated row is packed twice
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(n for _, n in p) <= 64
    assert packing.pack_documents(none).count() == 0
    with_ids = packing.pack_documents(odd.where("doc_id = 8"), with_ids=True).collect()
    assert with_ids[0].ids == [*tokenizer.encode("one", add_special_tokens=False).ids, 2]

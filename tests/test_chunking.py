from __future__ import annotations

from pyspark.sql import functions as F

from codexframe.functions import chunking


def loop(n):
    """Windows as the rule states them: 320 words, the rest absorbed if short, 40 shared."""
    out, start = [], 0
    while start < n:
        stop = min(start + 320, n)
        if 0 < n - stop < 180:
            stop = min(start + 380, n)
        out.append((start, stop))
        if stop >= n:
            break
        start = max(stop - 40, start + 1)
    return out


def test_closed_form_equals_the_loop(spark):
    rows = spark.range(0, 4000).select(F.col("id").alias("n"), chunking.windows(F.col("id")).alias("w")).collect()
    assert all([tuple(w) for w in r.w] == loop(r.n) for r in rows)


def test_twelve_hundred_words(spark):
    words = [f"word-{i}" for i in range(1200)]
    rows = chunking.chunk_text(spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None)], "id long, text string")).orderBy("chunk_index").collect()
    assert [r.content.split()[0] for r in rows] == ["word-0", "word-280", "word-560", "word-840"]
    assert [r.chunk_index for r in rows] == [0, 1, 2, 3] and all(300 <= r.token_count <= 500 for r in rows)
    for a, b in zip(rows, rows[1:]):
        assert a.content.split()[-40:] == b.content.split()[:40]
    assert {w for r in rows for w in r.content.split()} == set(words)


def test_sections_keep_their_place(spark):
    s = lambda n, page: (" ".join(["w"] * n), page, f"Trang {page}")
    df = spark.createDataFrame([("d", [s(500, 7), s(700, 8)])], "id string, sections array<struct<text:string,page_number:int,source_label:string>>")
    rows = chunking.chunk_sections(df, "id").orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.page_number) for r in rows] == [(0, 7), (1, 7), (2, 8), (3, 8), (4, 8)]
    assert all(r.source_label == f"Trang {r.page_number}" for r in rows)


def test_cycled_blocks(spark):
    blocks = chunking.fixed_blocks(spark.createDataFrame([(1, " ".join(map(str, range(950))))], "id long, text string"), "text")
    assert [r.n_words for r in blocks.orderBy("block_index").collect()] == [400, 400, 150]
    samples = chunking.cycled_samples(blocks, ["block_index"], 7).orderBy("sample_id").collect()
    assert [r.block_index for r in samples] == [0, 1, 2, 0, 1, 2, 0]


def test_cycled_blocks_over_many_partitions_and_none(spark):
    blocks = spark.range(1000).repartition(7).withColumnRenamed("id", "block_index")
    got = {r.sample_id: r.block_index for r in chunking.cycled_samples(blocks, ["block_index"], 2500).collect()}
    assert got == {i: i % 1000 for i in range(2500)}
    assert chunking.cycled_samples(blocks.where("false"), ["block_index"], 5).count() == 0

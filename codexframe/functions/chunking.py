"""Overlapping word windows in closed form, so that chunking is one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codexframe.functions.text import BLANK
from codexframe.sources.scratch import written

# fixed values: words in a chunk, shared words, and the rest that a chunk absorbs
WINDOW, SHARED, WIDEST, SHORT_REST = 320, 40, 380, 180
#: Tokens that a word is taken to be.
TOKENS_PER_WORD = 1.3


def words(text: Column) -> Column:
    """Words between white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{BLANK}+"), "")


def token_estimate(n_words: Column) -> Column:
    return F.ceil(n_words * F.lit(TOKENS_PER_WORD)).cast("int")


def windows(n: Column) -> Column:
    """Array of ``struct(first, stop)`` word ranges of a text of ``n`` words.

    Full windows start every ``WINDOW - SHARED`` words while too much follows to be absorbed. What is
    left after ``k`` of them is one window if it fits the widest, else a widest one and a tail.
    """
    stride = WINDOW - SHARED
    k = F.greatest(F.lit(0), F.floor((n - (WINDOW + SHORT_REST)) / stride) + 1).cast("int")
    at = lambda i: F.struct((i * stride).cast("int").alias("first"), (i * stride + WINDOW).cast("int").alias("stop"))
    full = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), lambda i: i < k), at)
    last = k * stride
    pair = lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("stop"))
    rest = F.when(n - last <= WIDEST, F.array(pair(last, n))).otherwise(
        F.array(pair(last, last + WIDEST), pair(last + WIDEST - SHARED, n))
    )
    return F.when(n > 0, F.concat(full, rest)).otherwise(F.expr("cast(array() as array<struct<first:int,stop:int>>)"))


def chunk_text(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per chunk: the kept columns, ``chunk_index`` (from 0), ``content, n_words, token_count``."""
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]
    split = df.select(*keep, words(F.col(text_col)).alias("__w"))
    # the outer form: an inner generator would make the planner repeat the split in a filter
    out = split.select(*keep, "__w", F.posexplode_outer(windows(F.size("__w"))).alias("chunk_index", "__r")).where("__r is not null")
    n = F.col("__r.stop") - F.col("__r.first")
    content = F.array_join(F.slice("__w", F.col("__r.first") + 1, n), " ")
    return out.select(*keep, "chunk_index", content.alias("content"), n.alias("n_words"), token_estimate(n).alias("token_count"))


def chunk_sections(df: DataFrame, id_col: str, sections_col: str = "sections") -> DataFrame:
    """Chunks of located sections: each section apart, ``chunk_index`` over the whole document.

    ``sections`` is an array of ``struct(text, page_number, source_label)``; page and label go along.
    """
    located = df.select(F.col(id_col).alias("__id"), F.posexplode(sections_col).alias("__at", "__s"))
    flat = located.select("__id", "__at", F.col("__s.text").alias("text"), F.col("__s.page_number").alias("page_number"), F.col("__s.source_label").alias("source_label"))
    parts = chunk_text(flat, "text").withColumnRenamed("chunk_index", "__local")
    order = Window.partitionBy("__id").orderBy("__at", "__local")
    numbered = parts.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("int"))
    return numbered.select(F.col("__id").alias(id_col), "chunk_index", "content", "token_count", "page_number", "source_label")


def fixed_blocks(df: DataFrame, text_col: str, size: int = 400, keep: list[str] | None = None) -> DataFrame:
    """Blocks of ``size`` words, the last one shorter: ``block_index, content, n_words``."""
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]
    split = df.select(*keep, words(F.col(text_col)).alias("__w")).withColumn("__n", F.ceil(F.size("__w") / size).cast("int"))
    at = F.explode_outer(F.filter(F.sequence(F.lit(0), F.greatest("__n", F.lit(1)) - 1), lambda i: i < F.col("__n")))
    out = split.select(*keep, "__w", at.alias("block_index")).where("block_index is not null")
    part = F.slice("__w", F.col("block_index") * size + 1, F.lit(size))
    return out.select(*keep, "block_index", F.array_join(part, " ").alias("content"), F.size(part).alias("n_words"))


def cycled_samples(blocks: DataFrame, order: list[str], n: int) -> DataFrame:
    """``n`` samples, ``sample_id`` from 0, that go through the ordered blocks over and over.

    Blocks are range-sorted and numbered by their sorted partition's offset, so no task holds all of them;
    blocks that tie in ``order`` come in any order. Without a block there is no sample.
    """
    spark = blocks.sparkSession
    placed = written(blocks.sort(*order).withColumn("__at", F.monotonically_increasing_id()), "blocks")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row for each sorted partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    numbered = placed.withColumn("__part", part).join(F.broadcast(firsts), "__part").withColumn("__i", F.col("__first") + place)
    numbered = numbered.drop("__at", "__part", "__n", "__first")
    count = placed.count()
    samples = spark.range(n if count else 0).select(F.col("id").alias("sample_id"), F.expr(f"id % {max(count, 1)}").alias("__i"))
    return samples.join(numbered, "__i").drop("__i")

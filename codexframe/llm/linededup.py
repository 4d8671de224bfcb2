"""Line dedup by site-relative frequency: lines that too large a share of a host's pages hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexframe.llm.common import SENT_BYTES, SENT_ROWS, materialize, table_bytes


#: A line that only two pages share makes them copies of each other rather than pages of one template.
MIN_PAGES = 3


def _key(line: Column) -> Column:
    """128 bits of a line without surrounding spaces; null for a line without a word."""
    return F.when(_has_word(line), F.struct(F.xxhash64(_bare(line)).alias("h"), F.xxhash64(_bare(line), F.lit(1)).alias("g")))


def _has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def boilerplate(
    df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = MIN_PAGES
) -> DataFrame:
    """Lines on more than ``ratio`` of a host's pages, and on ``min_pages`` at least: ``host, h, g, pages, share``.

    A page counts once for a line however often it holds it. Counts are partial sums before the shuffle,
    so a line on every page costs one row per task. Pages without a host belong to no site.
    """
    pages = df.select(F.col(host_col).alias("host"), F.col(text_col).cast("string").alias("text")).where("host is not null")
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), _has_word)
    # one array of 128-bit keys per page; distinct on the text is hashed, on structs it would be quadratic
    keys = pages.select("host", F.explode(F.array_distinct(F.transform(lines, lambda x: _bare(x)))).alias("line"))
    counts = (
        keys.groupBy("host", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g"))
        .agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    share = F.col("pages") / F.col("total")
    return counts.join(totals, "host").withColumn("share", share).where(F.col("share") > ratio).drop("total")


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")


def drop_boilerplate(
    df: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = 0.1,
    min_pages: int = MIN_PAGES,
    salts: int = 64,
    count_col: str | None = None,
) -> DataFrame:
    """``df`` with the boilerplate lines of each row's host taken out of its text.

    Columns and rows stay as they are, repeated rows included; a text that loses nothing stays as it
    was, null too, and one that loses every line becomes empty. Rows without a host are left alone.
    ``count_col`` adds the number of lines dropped.

    A host's list is short: lines on more than ``ratio`` of its pages number less than a page's mean
    lines / ``ratio``. The lists are broadcast if they are few by measure; else rows meet them by host
    and a salt, so that one host with a third of all rows is dealt to ``salts`` tasks. Columns of any
    names may come along; rows travel as one struct.
    """
    found = materialize(boilerplate(df, host_col, text_col, ratio, min_pages), "boilerplate")
    lists = found.groupBy("host").agg(F.collect_set(F.struct("h", "g")).alias("lines"))
    rows = df.select(F.struct("*").alias("row"), F.col(host_col).alias("host"), F.col(text_col).cast("string").alias("text"))
    if found.count() <= SENT_ROWS and table_bytes(found) <= SENT_BYTES:
        met = rows.join(F.broadcast(lists), "host", "left")
    else:
        lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(lists, ["host", "salt"], "left")
    parts = F.split("text", "\n")
    met = met.withColumn("keys", F.when(F.col("lines").isNotNull(), F.transform(parts, _key)))
    # one hashed intersection a page; only what it finds is compared line by line
    known = F.array_intersect(F.transform("keys", lambda k: k["h"]), F.transform("lines", lambda x: x["h"]))
    met = met.withColumn("known", F.array_compact(known))
    met = met.withColumn("listed", F.when(F.size("known") > 0, F.filter("lines", lambda x: F.array_contains("known", x["h"]))))
    stays = lambda x, i: ~F.coalesce(F.array_contains("listed", F.get("keys", i)), F.lit(False))
    met = met.withColumn("kept", F.when(F.size("listed") > 0, F.filter(parts, stays)))
    lost = F.coalesce(F.when(F.col("kept").isNotNull(), F.size(parts) - F.size("kept")), F.lit(0)).cast("long")
    met = met.withColumn("lost", lost)
    kind = df.schema[text_col].dataType
    text = F.when(F.col("lost") > 0, F.array_join("kept", "\n").cast(kind)).otherwise(F.col("row").getField(text_col))
    out = [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns]
    return met.select(*out, *([F.col("lost").alias(count_col)] if count_col else []))

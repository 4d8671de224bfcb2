"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Documents longer than the capacity are cut; every remaining item is placed by bulk-synchronous
best-fit. A round range-sorts the unplaced items and the gaps of open sequences by size, sweeps each
range from large to small so that an item takes the tightest gap seen (its successor in the order),
settles what is left between the ranges by rank, updates the gaps, and repeats. Items that no gap can
hold open new sequences. Only one count per range reaches the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexframe.llm.common import SENT_ROWS, discard, materialize, slices, worker_cache

#: Sequences are opened if the open ones have slots for less than one in so many of the items left.
FEW = 4
#: Rows that one range of a sweep should hold.
ROWS_PER_RANGE = 100_000


def tokenizer_path(name: str = "byte_bpe_50k") -> str:
    """Folder-qualified stem of a public tokenizer's files on this machine."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json").removesuffix(".json")


def encoder(stem: str):
    """``texts -> id lists`` for one vocabulary in both of its file forms.

    The merge engine of the rank file gives the ids of the JSON file several times faster. It is used
    for texts in Latin-1 only, where both libraries cut words alike; any other text, and one that holds
    the string of an added token, goes to the tokenizer itself, which gives that token's id.
    """
    import base64
    import json
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    import tiktoken

    held = worker_cache()
    if ("fast", stem) not in held:
        with open(f"{stem}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        held["fast", stem] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(f"{stem}.json", encoding="utf-8") as file:
            held["added", stem] = [t["content"] for t in json.load(file).get("added_tokens", [])]
    fast, added = held["fast", stem], held["added", stem]

    def exact(text: str) -> list[int]:
        if ("exact", stem) not in held:
            from tokenizers import Tokenizer

            held["exact", stem] = Tokenizer.from_file(f"{stem}.json")
        return held["exact", stem].encode(text, add_special_tokens=False).ids

    def encode(text: str) -> list[int]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return exact(text)
        if any(t in text for t in added):
            return exact(text)
        return fast.encode_ordinary(text)

    return encode


def cut_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    stem: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Token pieces of every row: ``id, piece, start, length, ids_crc32`` (and ``ids`` on request).

    A document is its token ids and then ``end_id``; null text is empty and so one token long. A longer
    one is cut into pieces of ``capacity`` of which the first may be shorter.
    """
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    stem = stem or tokenizer_path()
    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = [StructField("id", kept.schema["id"].dataType)]
    fields += [StructField(c, LongType()) for c in ("piece", "start", "length", "ids_crc32")]
    fields += [StructField("ids", ArrayType(IntegerType()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        encode = encoder(stem)
        for batch in slices(batches):
            rows, pieces, starts, lengths, crcs, all_ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*(encode(text) if text else ()), end_id], "<u4")
                first = (len(ids) - 1) % capacity + 1
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (start, stop) in enumerate(zip(bounds, bounds[1:])):
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(stop - start)
                    crcs.append(zlib.crc32(ids[start:stop].tobytes()))
                    if with_ids:
                        all_ids.append(ids[start:stop].astype("<i4"))
            columns = [batch.column(0).take(pa.array(rows, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (pieces, starts, lengths, crcs)]
            columns += [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return kept.mapInArrow(run, StructType(fields))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range in descending size, gaps before items of their size: an item takes the last gap seen.

    Yields rows ``item, bin, size, ord``: matched pairs have both ids and no ``ord``; what is left has
    its place among the range's left items (in order) or left gaps (tightest last).
    """
    import numpy as np

    open_gaps: list[tuple[int, int]] = []
    left_items: list[tuple[int, int]] = []
    matched: list[tuple[int, int, int]] = []

    def batch(item, bin_, size, ord_):
        arrays = [pa.array(x, pa.int64()) for x in (item, bin_, size, ord_)]
        return pa.RecordBatch.from_arrays(arrays, names=["item", "bin", "size", "ord"])

    for rows in batches:
        is_gap, ids, sizes = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for gap, key, size in zip(is_gap.tolist(), ids.tolist(), sizes.tolist()):
            if gap:
                open_gaps.append((key, size))
            elif open_gaps:
                matched.append((key, open_gaps.pop()[0], size))
            else:
                left_items.append((key, size))
    if matched:
        item, bin_, size = (np.array(x) for x in zip(*matched))
        yield batch(item, bin_, size, [None] * len(item))
    if left_items:
        item, size = (np.array(x) for x in zip(*left_items))
        yield batch(item, [None] * len(item), size, np.arange(len(item)))
    if open_gaps:
        bin_, size = (np.array(x) for x in zip(*open_gaps))
        yield batch([None] * len(bin_), bin_, size, np.arange(len(bin_)))


def _levels(capacity: int) -> list[tuple[int, int]]:
    """Size classes ``lo..hi``, large to small: of the first ones as many items fit as the number of the class."""
    fits = [k for k in (1, 2, 3, 4, 6, 16) if k < capacity] + [capacity + 1]
    bounds = [(capacity // more + 1, capacity // k) for k, more in zip(fits, fits[1:])]
    return [x for x in bounds if x[0] <= x[1]]


def _resolve(counts: dict[int, tuple[int, int]]) -> tuple[list[tuple], list[tuple], int]:
    """Rank intervals by which left items of a range take left gaps of the ranges above it.

    ``counts``: range -> (left items, left gaps). Returns item intervals ``(range, first, stop, shift)``
    with match number = ord + shift, gap intervals with match number = shift - ord, and how many match.
    """
    stack: list[list[int]] = []
    items, gaps, number = [], [], 0
    for part in sorted(counts):
        n_items, n_gaps = counts[part]
        done = 0
        while done < n_items and stack:
            above, left = stack[-1]
            take = min(n_items - done, left)
            items.append((part, done, done + take, number - done))
            gaps.append((above, left - take, left, number + left - 1))
            number, done = number + take, done + take
            stack[-1][1] -= take
            if not stack[-1][1]:
                stack.pop()
        if n_gaps:
            stack.append([part, n_gaps])
    return items, gaps, number


def _numbered(rows: DataFrame, intervals: list[tuple], sign: int) -> DataFrame:
    """``rows`` (part, ord) with their match number ``no``, null outside of all intervals.

    There are fewer than two intervals for each range of the sweep; beyond ``SENT_ROWS`` of them they are shuffled.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame(intervals or [(-1, 0, 0, 0)], "p int, first long, stop long, shift long")
    on = F.expr("part = p and ord >= first and ord < stop")
    return rows.join(F.broadcast(table) if len(intervals) <= SENT_ROWS else table, on, "left").withColumn("no", F.col("shift") + sign * F.col("ord")).drop("p", "first", "stop", "shift")


def _left(swept: DataFrame) -> tuple[dict[int, tuple[int, int]], int, int, int]:
    """What a sweep left: items and gaps of each range, and the least, the largest and the total size of the items. One row for each range."""
    item = F.when(F.col("item").isNotNull(), F.col("size"))
    rows = swept.where("ord is not null").groupBy("part")
    rows = rows.agg(F.count("item").alias("i"), F.count("bin").alias("g"), F.min(item).alias("low"), F.max(item).alias("high"), F.sum(item).alias("total"))
    rows = rows.collect()
    low, high = min((r["low"] for r in rows if r["i"]), default=0), max((r["high"] for r in rows if r["i"]), default=0)
    return {r["part"]: (r["i"], r["g"]) for r in rows}, low, high, sum(r["total"] or 0 for r in rows)


def best_fit(items: DataFrame, capacity: int) -> DataFrame:
    """Assign ``items`` (``item`` long, unique; ``size`` long, 1..capacity) to bins: ``item, size, bin``.

    Size classes go from large to small. In a class, each gap offers as many equal slots as surely hold
    the class's largest item (one, of the gap's own size, if it is shorter than two of them), so a wide
    gap takes many small items in one round. Rounds repeat until no gap fits, then what is left of the class
    opens bins: as many as hold it by the number of items that surely fit or, where more may fit, as its
    total size needs at least, and the remainder goes round again. Of the gaps that hold any item of the class only the
    tightest are offered, as many as give every item a slot. An empty input gives an empty result.
    """
    items = materialize(items.select("item", "size"), "items")
    sizes = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    placed: list[DataFrame] = []
    gaps: DataFrame | None = None
    next_bin = 0

    def gap_sizes(least: int) -> list[tuple[int, int]]:
        """``size, count`` of the gaps of at least this size, ascending: <= capacity rows."""
        if gaps is None:
            return []
        return sorted(tuple(r) for r in gaps.where(F.col("gap") >= least).groupBy("gap").agg(F.count(F.lit(1)).alias("n")).collect())

    for lowest, highest in _levels(capacity):
        mine = [s for s in sizes if lowest <= s <= highest]
        if not mine:
            continue
        lo, hi, n_todo = min(mine), max(mine), sum(sizes[s] for s in mine)
        per_bin = capacity // hi
        todo = items.where(F.col("size").between(lo, hi))
        smaller = min(sizes)
        by_size = gap_sizes(lo)
        while n_todo:
            n_gaps, widest, wide_slots = 0, 0, 0  # wider gaps than needed for every item stay out
            for gap, n in by_size:
                if wide_slots >= n_todo:
                    break
                m = max(1, gap // hi)
                widest, n_gaps = gap, n_gaps + n * m
                wide_slots += n * m * (gap >= hi)
            offered = todo.select(F.lit(False).alias("is_gap"), F.col("item").alias("id"), "size")
            if n_gaps:
                m = F.greatest(F.lit(1), F.floor(F.col("gap") / F.lit(hi))).cast("int")
                fitting = gaps.where(F.col("gap").between(by_size[0][0], widest)).withColumn("m", m)
                slots = fitting.select("bin", F.floor(F.col("gap") / F.col("m")).alias("size"), F.explode(F.sequence(F.lit(1), "m")))
                offered = offered.unionByName(slots.select(F.lit(True).alias("is_gap"), F.col("bin").alias("id"), "size"))
            order = [F.col("size").desc(), F.col("is_gap").desc(), F.xxhash64("id"), F.col("id")]
            ranges = max(1, math.ceil((n_todo + n_gaps) / ROWS_PER_RANGE))
            dealt = offered.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
            swept = dealt.select("is_gap", "id", "size").mapInArrow(_sweep, "item long, bin long, size long, ord long")
            swept = materialize(swept.withColumn("part", F.spark_partition_id()), "sweep", n_todo + n_gaps)
            counts, low, high, total = _left(swept)
            for_items, for_gaps, n_cross = _resolve(counts)
            n_left = sum(i for i, _ in counts.values()) - n_cross
            n_matched = n_todo - n_left
            now = swept.where("ord is null").select("item", "size", "bin")
            rest = swept.where("bin is null").select("item", "size", "part", "ord")
            if n_cross:
                settled = _numbered(rest, for_items, 1)
                met = _numbered(swept.where("item is null").select("bin", "part", "ord"), for_gaps, -1).where("no is not null").select("no", "bin")
                now = now.unionByName(settled.where("no is not null").select("no", "item", "size").join(met, "no").select("item", "size", "bin"))
                rest = settled.where("no is null").select("item", "size", "part", "ord")
            if n_matched:
                now = materialize(now, "placed", n_matched)
                placed.append(now)
                used = now.groupBy("bin").agg(F.sum("size").alias("used"))
                after = gaps.join(used, "bin", "left").select("bin", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
                before, gaps = gaps, materialize(after.where(F.col("gap") >= smaller), "gaps", next_bin)
                discard(before)
            if n_left and n_cross:
                low, high, total = rest.agg(F.min("size"), F.max("size"), F.sum("size")).first()
            by_size = gap_sizes(low) if n_left else []
            if n_left:
                lo, hi, per_bin = low, high, capacity // high
            if FEW * sum(n * max(1, gap // hi) for gap, n in by_size) < n_left:
                # gaps hold hardly any of them. Rank over all ranges: the rows before this range, then the place in it
                firsts, before_it, taken = [], 0, Counter()
                for part, first, stop, _ in for_items:
                    taken[part] += stop - first
                for part in sorted(counts):
                    firsts.append((part, taken[part], counts[part][0], before_it - taken[part]))
                    before_it += counts[part][0] - taken[part]
                n_open = math.ceil(n_left / per_bin)
                if (per_bin + 1) * low <= capacity:  # a bin may take more than surely fit: open no more than are needed
                    n_open = min(n_open, math.ceil(total / capacity))
                ranked = _numbered(rest, firsts, 1).withColumn("bin", F.floor(F.col("no") / F.lit(per_bin)).cast("long"))
                if n_open * per_bin < n_left:
                    ranked = materialize(ranked, "ranked", n_left)
                opened = ranked.where(F.col("bin") < n_open).select("item", "size", (F.col("bin") + F.lit(next_bin)).alias("bin"))
                opened = materialize(opened, "placed", n_left)
                placed.append(opened)
                fresh = opened.groupBy("bin").agg((F.lit(capacity) - F.sum("size")).alias("gap")).where(F.col("gap") >= smaller)
                before, gaps = gaps, materialize(fresh if gaps is None else gaps.unionByName(fresh), "gaps", next_bin + n_open)
                discard(before)
                next_bin += n_open
                rest, n_left = ranked.where(F.col("bin") >= n_open), max(0, n_left - n_open * per_bin)
                by_size = gap_sizes(lo) if n_left else []
            if n_left:
                rest = materialize(rest.select("item", "size"), "items", n_left)
            discard(swept, None if todo is items else todo)
            todo, n_todo = rest, n_left
    if not placed:
        return items.select("item", "size", F.lit(0).cast("long").alias("bin")).where("false")
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    stem: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Pack every row of ``df`` into sequences of at most ``capacity`` tokens.

    Returns per piece ``id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).
    Offsets within a sequence are gapless from 0, its longest piece first. Repeated rows and null ids
    are packed as often as they come. Null or empty text is one token long. An empty table gives an
    empty result. ``df`` may hold any other columns.
    """
    pieces = cut_documents(df, id_col, text_col, capacity, end_id, stem, with_ids)
    pieces = materialize(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    columns = [c for c in pieces.columns if c != "item"]
    part = best_fit(pieces.where(F.col("length") < capacity).select("item", F.col("length").alias("size")), capacity)
    order = Window.partitionBy("bin").orderBy(F.col("size").desc(), "item")
    offset = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    part = part.select("item", (F.col("bin") * 2).alias("sequence_id"), F.coalesce(offset, F.lit(0)).cast("long").alias("offset"))
    packed = pieces.where(F.col("length") < capacity).join(part, "item").select(*columns, "sequence_id", "offset")
    whole = pieces.where(F.col("length") == capacity).select(
        *columns, (F.col("item") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(whole)

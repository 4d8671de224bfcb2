"""Mixing sources to target weights along a time-varying curriculum.

Each source's weight is a schedule over training time. Its integral is the source's cumulative demand
for words; inverting it turns a document's place in its source's order into a training position, and a
range sort by position gives the training order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexframe.llm.common import materialize, word_count

#: Documents that a bucket of one source should hold at most; running sums go over ordered buckets, then within one.
ROWS_PER_BUCKET = 10_000


def targets(sources: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), most: float = 3.0, by_size: bool = True) -> DataFrame:
    """Words to take from each source: ``sources`` (``source, source_size``) with ``weight, target``.

    Sources by code point, null last, weigh ``cycle`` in turn and share the sum of all sizes. No target
    exceeds ``most`` times its source's size; the excess goes to the others by weight until none is
    above. The level ``target / weight`` is found by sorting the sources by the level at which each is
    full: those below the answer are full. Sizes of 0 get 0. A table of sources, not of documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    weight = F.array(*[F.lit(float(x)) for x in cycle])[F.pmod(n, F.lit(len(cycle)))]
    weighed = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    beyond = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy())
    level = (everything - before) / beyond
    levels = weighed.withColumn("level", level).withColumn("place", F.row_number().over(fill))
    # the level of the first source, in order of filling up, that it leaves not full
    open_at = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    free = F.min(open_at).over(Window.partitionBy())["level"]
    chosen = levels.withColumn("target", F.least(F.col("cap"), free * F.col("weight")))
    return chosen.select(*sources.columns, "weight", "target")


def _order(id_col: str = "id") -> Column:
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def plan(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    cycle: tuple[float, ...] = (1, 2, 3),
    most: float = 3.0,
    carry: list[str] | None = None,
    schedule: DataFrame | None = None,
) -> DataFrame:
    """Every row's share of the mix: ``id, source, size, source_size, weight, target, first, taken``.

    ``size`` is the number of words of the whole text (null: 0). A source's rows stand in the order of the
    MD5 of their id; ``first`` is the number of the source's words before the row. The source is read over
    and over until its target, in whole words, is reached, so only the row in which that happens is taken
    in part, and ``taken`` sums to the rounded target. Reruns agree; repeated rows with one id differ in
    ``first`` only and may change places. Null ids come as if empty, a null source is a source.

    Running sums go over ordered buckets of each source and then within a bucket. There are a power of 16
    of them, 4096 at least, so that none holds more than about ``ROWS_PER_BUCKET`` rows even of a source
    with all rows. ``carry`` names columns to keep as they are; they are
    shuffled once, with their rows. With a ``schedule`` (see ``readings``) the result also has each source's
    ``segs``; it meets the sources before they meet their rows.
    """
    carry = carry or []
    digits = max(3, math.ceil(math.log(max(1, df.count() / ROWS_PER_BUCKET), 16)))
    rows = df.select(
        *carry, F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size")
    )
    # a text key that is never null, so that one partitioning serves the window and the join
    rows = rows.withColumn("at", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("key", _order())
    rows = rows.withColumn("bucket", F.conv(F.substring("key", 1, digits), 16, 10).cast("long"))
    rows = rows if carry else materialize(rows, "sizes")
    buckets = materialize(rows.groupBy("at", "source", "bucket").agg(F.sum("size").alias("in_bucket")), "buckets")
    sums = targets(buckets.groupBy("at", "source").agg(F.sum("in_bucket").alias("source_size")), cycle, most)
    sums = sums if schedule is None else _scheduled(sums, schedule)
    over_buckets = Window.partitionBy("at").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("at", "bucket", F.coalesce(F.sum("in_bucket").over(over_buckets), F.lit(0)).alias("before"))
    starts = materialize(starts.join(sums.drop("source"), "at"), "starts")
    within = Window.partitionBy("at", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(starts, ["at", "bucket"])
    planned = joined.select(
        *carry, "id", "source", "size", "source_size", "weight", "target", (F.col("before") + F.col("inside")).alias("first"),
        *([] if schedule is None else ["segs"]),
    )
    taken = F.lit(0).cast("long")
    for epoch in range(int(-(-most // 1))):
        taken = taken + _overlap(epoch)
    return planned.withColumn("taken", taken)


def _overlap(epoch: int) -> Column:
    """Words of the row that the mix takes in one reading of its source."""
    reach = F.round("target").cast("long") - F.lit(epoch) * F.col("source_size") - F.col("first")
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), reach))


#: Weight over training time, ``(t, w)`` with straight lines between: even, late and early.
SHAPES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)), ((0.0, 2.0), (0.5, 0.5), (1.0, 0.5)))


def curriculum(df: DataFrame, source_col: str = "source", shapes: tuple = SHAPES) -> DataFrame:
    """A schedule ``source, t, w`` for every source of ``df``: by code point, null last, they get ``shapes`` in turn."""
    sources = df.select(F.col(source_col).cast("string").alias("source")).distinct()
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    points = F.array(*[F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in x]) for x in shapes])
    dealt = sources.withColumn("n", F.pmod(n, F.lit(len(shapes))))
    return dealt.select("source", F.explode(points[F.col("n")]).alias("p")).select("source", "p.*")


def segments(schedule: DataFrame) -> DataFrame:
    """``source, segs``: the linear pieces of each source's schedule that have weight, in order, with the integral up to each end."""
    by_time = Window.partitionBy("source").orderBy("t")
    pieces = schedule.select(
        "source", F.col("t").alias("t0"), F.col("w").alias("w0"), F.lead("t").over(by_time).alias("t1"), F.lead("w").over(by_time).alias("w1")
    ).where("t1 > t0")
    pieces = pieces.withColumn("area", F.expr("(t1 - t0) * (w0 + w1) / 2"))
    upto = F.sum("area").over(Window.partitionBy("source").orderBy("t0"))
    whole = F.sum("area").over(Window.partitionBy("source"))
    pieces = pieces.withColumn("a1", upto).withColumn("all", whole).where("area > 0").withColumn("a0", F.expr("a1 - area"))
    return pieces.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("t0", "t1", "w0", "w1", "a0", "a1", "all"))).alias("segs"))


def _scheduled(rows: DataFrame, schedule: DataFrame | None) -> DataFrame:
    """``rows`` with their source's ``segs``; null without a schedule."""
    if schedule is None:
        return rows if "segs" in rows.columns else rows.withColumn("segs", F.lit(None).cast(_SEGS))
    a, b = rows.drop("segs").alias("a"), segments(schedule).alias("b")
    return a.join(b, F.expr("a.source <=> b.source"), "left").select("a.*", "b.segs")


_SEGS = "array<struct<t0:double,t1:double,w0:double,w1:double,a0:double,a1:double,all:double>>"


def _position(epoch: Column) -> Column:
    """Training time at which the demand of the row's source reaches the words before this reading of the row."""
    before = epoch * F.col("source_size") + F.col("first")
    demand = F.least(before / F.greatest(F.lit(1.0), F.col("target")), F.lit(1.0))
    # the last one if rounding puts the demand beyond every end
    hit = F.coalesce(F.get(F.filter("segs", lambda x: demand * x["all"] <= x["a1"]), F.lit(0)), F.get(F.col("segs"), F.size("segs") - 1))

    def invert(seg: Column) -> Column:
        # words wanted beyond the segment's start: w0 * u + (w1 - w0) / (2 d) * u * u, u = time in it
        rest, slope = demand * seg["all"] - seg["a0"], (seg["w1"] - seg["w0"]) / (seg["t1"] - seg["t0"])
        root = F.sqrt(F.greatest(F.lit(0.0), seg["w0"] * seg["w0"] + 2 * slope * rest))
        u = 2 * rest / F.when(seg["w0"] + root > 0, seg["w0"] + root)
        return F.least(seg["t1"], seg["t0"] + F.greatest(F.lit(0.0), F.coalesce(u, F.lit(0.0))))

    return F.when(F.size("segs") > 0, F.transform(F.array(hit), invert)[0]).otherwise(demand)


def readings(planned: DataFrame, schedule: DataFrame | None = None, most: float = 3.0) -> DataFrame:
    """``planned`` with ``readings``: each reading of the row that the mix takes, ``epoch, take, position``, in order.

    ``schedule`` (``source, t, w``; t from 0 to 1, w >= 0) is each source's weight over training time,
    linear between its rows; if it isn't given, that of ``plan`` holds, and sources without one keep a
    constant weight. The cumulative demand of a source is its target times the schedule's integral,
    scaled to 1. A reading starts where that demand reaches the words before it: a quadratic in each
    linear segment, solved in closed form. A source's schedule is a few rows, and is joined by source,
    a null source with a null one. Only times between its first and last row count: one that ends early is
    used up there. Without any weight (no row, one row, all 0), a source keeps a constant weight. An empty
    table gives an empty result.
    """
    read = [
        F.struct(F.lit(e).alias("epoch"), _overlap(e).alias("take"), _position(F.lit(e)).alias("position")) for e in range(int(-(-most // 1)))
    ]
    return _scheduled(planned, schedule).withColumn("readings", F.filter(F.array(*read), lambda x: x["take"] > 0)).drop("segs")


def positions(planned: DataFrame, schedule: DataFrame | None = None, most: float = 3.0) -> DataFrame:
    """One row per reading of a row of ``plan`` that the mix takes: ``id, epoch, take, position``.

    As ``readings``; the result is range-sorted by position, then id.
    """
    read = readings(planned, schedule, most).select("id", F.explode("readings").alias("r"))
    return read.select("id", "r.*").orderBy("position", "id", "epoch")


def repeat_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    cycle: tuple[float, ...] = (1, 2, 3),
    most: float = 3.0,
    by_half: bool = True,
    schedule: DataFrame | None = None,
) -> DataFrame:
    """``docs`` in training order, each whole row as often as the mix reads it, in its columns.

    A reading that the target cuts counts if at least half of its words lie within the target
    (``by_half``), else whenever it takes any. Documents without words, null texts too, can't be taken.
    Null sources are one source, a null id counts as an empty one, repeated rows are read each, other columns
    may have any names, and an empty table stays empty.
    The order follows ``schedule`` (see ``readings``), else that of ``curriculum``.
    """
    flat = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("s"), F.col(text_col).alias("t"), F.col(id_col).alias("i"))
    schedule = curriculum(docs, source_col) if schedule is None else schedule
    planned = plan(flat, "i", "s", "t", cycle, most, carry=["row"], schedule=schedule)
    readings = F.expr(f"explode(sequence(0, {int(-(-most // 1)) - 1}))")
    read = planned.select("*", readings.alias("epoch"))
    reach = F.round("target").cast("long") - F.col("epoch") * F.col("source_size") - F.col("first")
    enough = reach * 2 >= F.col("size") if by_half else reach > 0
    read = read.where((F.col("size") > 0) & enough)
    return read.withColumn("position", _position(F.col("epoch"))).orderBy("position", "id", "epoch").select("row.*")

"""Pairs of texts whose shingle sets are similar: every such pair, by prefixes of the sets in one order.

Two sets of similarity ``s`` share one of the first ``m - ceil(s * m) + 1`` elements of each under any one
order of all elements. With the common elements last, few texts meet under one element.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexframe.llm.common import discard, materialize, slices

#: Shingles in a block of texts, about. A shingle in so many texts of one block counts as common there.
BLOCK_SHINGLES, COMMON_TEXTS = 1 << 21, 2
#: Common shingles that are put last. Those beyond stand in at most (mean shingles of a text / MOST_COMMON) of all texts.
MOST_COMMON = 1 << 17


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """Unsigned XXH64 (seed 42) of each shingle of a text, repeats included: A-Z lower-cased, words cut at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return np.zeros(0, "<u8")
    joined, k, digest = b" ".join(words), min(shingle_words, len(words)), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, stops = (ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts, stops)), "<u8", len(starts))


def shingle_set(text: str | None, shingle_words: int) -> np.ndarray:
    """The distinct shingles of a text as signed 64-bit hashes, ascending."""
    return np.unique(shingle_hashes(text, shingle_words).view("<i8"))


def common_shingles(texts: DataFrame, shingle_words: int) -> np.ndarray:
    """Rows ``hash, count`` of the most common shingles of all ``texts`` (one column), by hash: at most ``MOST_COMMON``.

    Each block of texts reports what is common in it, copies left aside; a shingle that is common over all
    is common in a block at least. The counts only set the order of shingles, no result depends on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sets: list[np.ndarray] = []

        def report() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            often = n >= COMMON_TEXTS
            return pa.RecordBatch.from_arrays([pa.array(h[often], pa.int64()), pa.array(n[often], pa.int64())], names=["h", "n"])

        held = 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                own = shingle_set(text, shingle_words)
                mark = xxhash.xxh3_64_intdigest(own.tobytes())
                if mark in seen:
                    continue
                seen.add(mark)
                sets.append(own)
                held += len(own)
                if held >= BLOCK_SHINGLES:
                    yield report()
                    seen.clear()
                    sets.clear()
                    held = 0
        if sets:
            yield report()

    found = texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    table = np.stack([top.column(c).to_numpy() for c in ("h", "n")], 1).astype(np.int64).reshape(-1, 2)
    return table[np.argsort(table[:, 0], kind="stable")]


def prefix(own: np.ndarray, common: np.ndarray, similarity: float) -> tuple[int, np.ndarray]:
    """The prefix of a shingle set, rare shingles first, and how many of it are rare."""
    times = np.zeros(len(own), np.int64)
    if len(common) and len(own):
        at = np.minimum(np.searchsorted(common[:, 0], own), len(common) - 1)
        times = np.where(common[at, 0] == own, common[at, 1], 0)
    first = np.argsort(times, kind="stable")[: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1]
    return int((times[first] == 0).sum()), own[first]


def _prefix_size(m: str, similarity: float) -> str:
    return f"({m} - ceil({similarity}D * {m} - 0.000000001D) + 1)"


def _needed(similarity: float) -> str:
    """SQL: elements that the prefixes of sets of ``xm`` and ``ym`` elements share at least if the sets are similar enough.

    All shared elements up to the end of the prefix that ends first lie in both prefixes; beyond it, at most
    the rest of that set can be shared.
    """
    rest = [f"{m} - {_prefix_size(m, similarity)}" for m in ("xm", "ym")]
    return f"{similarity / (1 + similarity)!r}D * (xm + ym) - 0.000001D - greatest({', '.join(rest)})"


def shared_prefixes(texts: DataFrame) -> DataFrame:
    """``h, uid, m, i, top`` of the prefix elements of ``texts`` (``uid, m, rare, hs``) that two texts at least share.

    ``top`` (``i, uid, m``) is the text in whose order the element comes first: of a group around one text, that is the most central.
    Common elements, at most ``MOST_COMMON``, are summed up before any shuffle; no other one stands in many of all texts.
    """
    index = texts.select("uid", "m", "rare", F.posexplode("hs").alias("i", "h"))
    own = F.struct("i", "uid", "m")
    by_h = Window.partitionBy("h").orderBy("i", "uid")
    rare = index.where("i < rare").select("h", "uid", "m", "i", F.lead("uid").over(by_h).alias("next"), F.first(own).over(by_h).alias("top"))
    rare = rare.where("next is not null or top.uid != uid").select("h", "uid", "m", "i", "top")
    often = index.where("i >= rare")
    tops = often.groupBy("h").agg(F.min(own).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "top")
    return rare.unionByName(often.select("h", "uid", "m", "i").join(F.broadcast(tops), "h"))


def central_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of each text with the top texts of half the elements at least that similar texts share: linear in the elements."""
    alike = f"least(m, top.m) >= {similarity}D * greatest(m, top.m)"
    met = shared.where("top.uid != uid").where(alike).groupBy("uid", F.col("top.uid").alias("other"))
    met = met.agg(F.count(F.lit(1)).alias("n"), F.first("m").alias("xm"), F.first("top.m").alias("ym"))
    return met.where(f"2 * n >= {_needed(similarity)}").select(F.least("uid", "other").alias("a"), F.greatest("uid", "other").alias("b"))


def cross_pairs(shared: DataFrame, texts: DataFrame, clusters: DataFrame, similarity: float) -> DataFrame:
    """All pairs ``a < b`` of texts (``uid, m, hs``) of different clusters that can be this similar by their prefixes.

    ``clusters`` holds ``uid, c`` of the texts that have one; any other is its own. An equality join on shared
    elements finds pairs whose places of the element leave room for enough others after it. Under an element,
    only texts outside of its largest cluster meet the others, so a dense cluster isn't compared with itself.
    What the two prefixes share in all then decides.
    """
    rows = shared.drop("top").join(clusters, "uid", "left").withColumn("c", F.coalesce("c", "uid"))
    rows = materialize(rows, "elements")
    sizes = rows.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("h")
    largest = sizes.agg(F.max_by("c", F.struct("n", "c")).alias("most"), F.count(F.lit(1)).alias("many")).where("many > 1").select("h", "most")
    met = materialize(rows.join(largest, "h"), "met")
    room = f"least(x.m - x.i, y.m - y.i) >= {similarity / (1 + similarity)!r}D * (x.m + y.m) - 0.000001D"
    alike = f"least(x.m, y.m) >= {similarity}D * greatest(x.m, y.m)"
    once = "(y.c = y.most or x.uid < y.uid)"
    pairs = met.where("c != most").alias("x").join(met.alias("y"), F.expr(f"x.h = y.h and x.c != y.c and {once} and {alike} and {room}"))
    pairs = materialize(pairs.select(F.least("x.uid", "y.uid").alias("a"), F.greatest("x.uid", "y.uid").alias("b")).distinct(), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    sets = texts.select("uid", "m", "hs").join(asked, "uid", "left_semi")
    mine, other = (sets.select(F.col("uid").alias(c), F.col("m").alias(f"{x}m"), F.col("hs").alias(f"{x}hs")) for c, x in (("a", "x"), ("b", "y")))
    both = pairs.join(mine, "a").join(other, "b")
    found = materialize(both.where(f"size(array_intersect(xhs, yhs)) >= {_needed(similarity)}").select("a", "b"), "candidates")
    discard(rows, met, pairs)
    return found


def similar_pairs(pairs: DataFrame, bodies: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """The ``pairs`` (``a, b``) of ``bodies`` (``uid, text``, one row each) whose shingle sets are this similar, from whole texts."""
    mine = bodies.select(F.col("uid").alias("a"), F.col("text").alias("text_a"))
    other = bodies.select(F.col("uid").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(mine, "a").join(other, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lru_cache(64)(lambda text: shingle_set(text, shingle_words))
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = own(x), own(y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")

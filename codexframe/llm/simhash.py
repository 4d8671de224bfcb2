"""SimHash near-duplicate classes by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at most five bits
have a segment that differs in at most one of them, so both agree on that segment with one bit left
out. Every fingerprint is indexed under its 64 one-wildcard segment variants, an equality join on the
variant finds the candidates, and the join condition verifies the whole distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexframe.llm.common import discard, heavy_join, keyed, materialize, slices
from codexframe.llm.components import connected_components
from codexframe.llm.setjoin import central_pairs, common_shingles, cross_pairs, prefix, shared_prefixes, shingle_hashes, similar_pairs

#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Largest distance for which one of three segments must differ in at most one bit.
MOST_BITS = 5


def _majority(hashes: np.ndarray) -> int:
    """The signed 64-bit value whose bits are set in over half of the hashes; 0 for none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        total += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    ones = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(ones, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """The signed 64-bit fingerprint of one text; 0 for a text without words."""
    return _majority(shingle_hashes(text, shingle_words))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """``id, fp`` of every row. Null and empty texts have fingerprint 0."""
    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = kept.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    from pyspark.sql.types import LongType, StructField, StructType

    return kept.mapInArrow(run, StructType([StructField("id", id_type), StructField("fp", LongType())]))


def _variants() -> str:
    """SQL array of the 64 one-wildcard variants: the variant's number above 22 bits of the segment."""
    out, number = [], 0
    for first, width in SEGMENTS:
        segment = f"(shiftrightunsigned(fp, {first}) & {(1 << width) - 1}L)"
        for bit in range(width):
            out.append(f"cast({segment} & {((1 << width) - 1) & ~(1 << bit)}L as int) + {number << 22}")
            number += 1
    return f"array({', '.join(out)})"


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _first_shared(k: str, a: str, b: str) -> str:
    """SQL condition: ``k`` is the first variant that fingerprints ``a`` and ``b``, which share it, have in common."""
    masks = [_signed(((1 << width) - 1) << first) for first, width in SEGMENTS]
    firsts = [sum(w for _, w in SEGMENTS[:n]) for n in range(3)]
    d = [f"bit_count(({a} ^ {b}) & {m}L)" for m in masks]
    v = f"shiftright({k}, 22)"
    own = [f"({v} = {firsts[n]} or (({a} ^ {b}) & {masks[n]}L) != 0)" for n in range(3)]
    return (
        f"case when {v} < {firsts[1]} then {own[0]} when {v} < {firsts[2]} then {d[0]} > 1 and {own[1]} "
        f"else {d[0]} > 1 and {d[1]} > 1 and {own[2]} end"
    )


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """All pairs ``a < b`` of distinct values ``fp`` that differ in at most ``max_bits`` bits, each once.

    A pair can meet under many variants; it counts only under the first that it shares, which the join
    condition works out from the two values. So nothing is emitted twice and no distinct is needed. The join is
    a merge join by hint: the planner's estimate leaves out the 64 variants, and it would send them all through the driver.
    """
    if not 0 <= max_bits <= MOST_BITS:
        raise ValueError(f"max_bits must lie in 0..{MOST_BITS}")
    index = fps.select("fp").distinct().select("fp", F.explode(F.expr(_variants())).alias("k"))
    close = f"bit_count(x.fp ^ y.fp) <= {max_bits} and {_first_shared('x.k', 'x.fp', 'y.fp')}"
    pairs = index.alias("x").join(index.alias("y").hint("merge"), F.expr(f"x.k = y.k and x.fp < y.fp and {close}"))
    return pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def simhash_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_bits: int = 4
) -> DataFrame:
    """Near-duplicate class of every row: ``id, fp, component_id``.

    ``component_id`` is the smallest id reachable over links of at most ``max_bits`` differing bits, the
    row's own included. Rows with one fingerprint form one class before anything is joined, so copies
    cost one aggregated row. Repeated rows are returned as often as they come. A null id is never the
    smallest; a class of null ids only has a null ``component_id``. Null and empty texts share
    fingerprint 0 and link like any other. Other columns of ``df`` are ignored.
    """
    rows = materialize(fingerprints(df, id_col, text_col, shingle_words), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    labels = connected_components(links(rows, max_bits)).withColumnRenamed("node", "fp")
    linked = materialize(classes.drop("n").join(labels, "fp"), "linked")  # only fingerprints with a link
    lowest = linked.groupBy("label").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    met = heavy_join(linked, lowest, ["label"]).select("fp", "component_id")
    by_fp = classes.join(met, "fp", "left").select("fp", "n", F.coalesce("component_id", "low").alias("component_id"))
    return heavy_join(rows, by_fp, ["fp"]).select("id", "fp", "component_id")


#: Fingerprints that lead the others which share a whole segment with them, about; only a leader's links are followed in a larger crowd.
LEADERS = 64


def leader_links(fps: DataFrame, max_bits: int = MOST_BITS) -> DataFrame:
    """The pairs of :func:`links` that have a leader: all of them, but in crowds of more than ``LEADERS``.

    A fingerprint leads if its hash falls into the share ``LEADERS / crowd``, its crowd being the most
    fingerprints that share a whole segment with it. So a dense group yields linearly many pairs.
    """
    values = fps.select("fp").distinct()
    parts = [f"struct({i} as s, shiftrightunsigned(fp, {at}) & {(1 << width) - 1}L as x)" for i, (at, width) in enumerate(SEGMENTS)]
    shared = values.select("fp", F.explode(F.expr(f"array({', '.join(parts)})")).alias("part"))
    crowds = shared.join(shared.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part").groupBy("fp").agg(F.max("n").alias("crowd"))
    dice = F.pmod(F.xxhash64(F.lit("leader"), "fp"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ranked = materialize(crowds.select("fp", (dice * F.col("crowd") < LEADERS).alias("leads")), "leaders")
    index = ranked.select("fp", "leads", F.explode(F.expr(_variants())).alias("k"))
    close = f"bit_count(x.fp ^ y.fp) <= {max_bits} and {_first_shared('x.k', 'x.fp', 'y.fp')}"
    once = "x.fp != y.fp and (not x.leads or x.fp < y.fp)"
    pairs = index.alias("x").join(index.where("leads").drop("leads").alias("y").hint("merge"), F.expr(f"x.k = y.k and {once} and {close}"))  # as in links
    return pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def text_key(text: Column) -> list[Column]:
    """``ka, kb``: 128 bits of a text; null as empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(whole).alias("ka"), F.xxhash64(F.lit(1), whole).alias("kb")]


def _profiles(texts: DataFrame, common: np.ndarray, similarity: float, shingle_words: int) -> DataFrame:
    """``ka, kb, fp, m, rare, hs`` of rows ``ka, kb, text``: fingerprint, number of distinct shingles, and their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps, sizes, rare, firsts = [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_hashes(text, shingle_words)
                own = np.unique(hashes.view("<i8"))
                n, first = prefix(own, common, similarity)
                fps.append(_majority(hashes))
                sizes.append(len(own))
                rare.append(n)
                firsts.append(first)
            columns = [*batch.columns[:2], pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(rare, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(firsts, pa.list_(pa.int64()))], names=["ka", "kb", "fp", "m", "rare", "hs"])

    return texts.mapInArrow(run, "ka long, kb long, fp long, m int, rare int, hs array<long>")


def similar_classes(rows: DataFrame, similarity: float = 0.8, shingle_words: int = 5) -> DataFrame:
    """Near-duplicate class of the texts of ``rows`` (``ka, kb`` of :func:`text_key`, ``text``): ``ka, kb, label``, one row a text.

    Texts are linked if the Jaccard similarity of their shingle sets, worked out from whole lower-cased (A-Z)
    texts, is at least ``similarity``; texts without words are alike. Classes are the connected components.

    Candidates come first from fingerprints: equal ones, and the links of deletion variants (``MOST_BITS``,
    with leaders in crowds). Of each shared element of the sets' prefixes the most central text is a
    candidate for the others. What verifies makes clusters. Then all pairs of different clusters that the
    prefixes allow are verified: these are all that can be similar enough, so no link is left out but those
    inside a cluster, which can't change a class. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    common = common_shingles(rows.select("text"), shingle_words)
    single = _profiles(rows.select("ka", "kb", "text"), common, similarity, shingle_words).dropDuplicates(["ka", "kb"])
    texts = materialize(single.withColumn("uid", F.monotonically_increasing_id()), "texts")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        asked = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
        wanted = materialize(texts.select("uid", "ka", "kb").join(asked, "uid", "left_semi"), "wanted")
        bodies = keyed(rows.select("ka", "kb", "text"), wanted, ["ka", "kb"], "inner").groupBy("uid").agg(F.first("text").alias("text"))
        found = materialize(similar_pairs(pairs, bodies, similarity, shingle_words), label)
        discard(wanted, pairs)
        return found

    shared = materialize(shared_prefixes(texts.select("uid", "m", "rare", "hs")), "shared")
    heads = texts.groupBy("fp").agg(F.min("uid").alias("head"), F.count(F.lit(1)).alias("n"))
    close = leader_links(heads)
    by_bits = close.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    same = texts.select("uid", "fp").join(heads.where("n > 1"), "fp").where("uid != head").select(F.col("head").alias("a"), F.col("uid").alias("b"))
    near = by_bits.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(same)
    first = verified(materialize(near.unionByName(central_pairs(shared, similarity)).distinct(), "candidates"), "links")
    clusters = materialize(connected_components(first).select(F.col("node").alias("uid"), F.col("label").alias("c")), "clusters")
    second = verified(cross_pairs(shared, texts, clusters, similarity), "links")
    discard(shared, clusters)
    labels = connected_components(first.unionByName(second)).withColumnRenamed("node", "uid")
    return texts.select("uid", "ka", "kb").join(labels, "uid", "left").select("ka", "kb", F.coalesce("label", "uid").alias("label"))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle_words: int = 5
) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, in its columns: the one of smallest id.

    Null ids come last; of repeated rows (one id, one text) any one stays. Null and empty texts are copies of
    one another. Other columns may have any names. The table is never copied: rows are told apart by id and
    a 128-bit key of the text, and what is dropped is taken out of the table itself.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), *text_key(F.col(text_col)), F.col(text_col).cast("string").alias("text"))
    classes = similar_classes(rows.select("ka", "kb", "text"), similarity, shingle_words)
    known = materialize(rows.groupBy("id", "ka", "kb").agg(F.count(F.lit(1)).alias("times")), "known")
    sizes = known.groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("n"))
    labelled = materialize(heavy_join(known, classes.join(sizes, ["ka", "kb"]), ["ka", "kb"]), "labelled")
    best = F.min(F.struct(F.col("id").isNull(), "id", "ka", "kb")).alias("best")
    chosen = labelled.groupBy("label").agg(best, F.count(F.lit(1)).alias("n")).select("label", "n", F.col("best.id").alias("best"), F.col("best.ka").alias("bka"), F.col("best.kb").alias("bkb"))
    judged = heavy_join(labelled, chosen, ["label"]).withColumn("stays", F.expr("id <=> best and ka = bka and kb = bkb"))
    judged = materialize(judged.select("id", "ka", "kb", "times", "stays"), "judged")
    discard(known, labelled)
    left = keyed(rows, materialize(judged.where("not stays").select("id", "ka", "kb"), "dropped"), ["id", "ka", "kb"], "left_anti")
    tied = materialize(judged.where("stays and times > 1").select("id", "ka", "kb"), "tied")
    if tied.isEmpty():
        return left.select("row.*")
    first = F.row_number().over(Window.partitionBy("id", "ka", "kb").orderBy(F.lit(0))).alias("n")
    single = keyed(left, tied, ["id", "ka", "kb"], "left_semi").select("row", first).where("n = 1").select("row")
    return keyed(left, tied, ["id", "ka", "kb"], "left_anti").select("row").unionByName(single).select("row.*")

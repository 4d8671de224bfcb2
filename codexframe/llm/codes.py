"""Compression of vectors to one byte per part, in integers, with a metric tree over each part's entries.

Vectors are scaled, floored and cut into parts. Each part position has a codebook that rounds of assignment
and averaging move. The nearest entry of a part is found in a vantage-point tree by branch and bound: radii
and distances are rounded outwards, a child that ties with the best is still visited, and what counts is
always the integer distance, so the answer is that of comparing every entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from codexframe.llm.common import discard, heavy_join, materialize

#: Factor before flooring; parts of a vector; entries of a codebook; rounds of assignment and averaging.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Entries that a leaf of a tree compares one by one.
LEAF = 4
#: Rows that go down a tree at a time.
ROWS = 4096
#: Size from which a scaled component counts as not finite: no error of such vectors would fit 64 bits, and sums must fit 38 digits.
MOST = 1e18
#: Share by which a rounded square root may be off, with much room.
SLACK = 1e-12


@dataclass(frozen=True)
class Node:
    """Entries below a vantage point, in a nearer and a farther half; ``low`` and ``high`` bound each half's distances from it."""

    members: tuple[int, ...]
    halves: tuple[Node, ...] = ()
    low: tuple[float, ...] = ()
    high: tuple[float, ...] = ()


def _root_down(squares: np.ndarray) -> np.ndarray:
    """At most the square roots."""
    return np.sqrt(squares.astype(np.float64)) * (1 - SLACK) - 1


def _root_up(squares: np.ndarray) -> np.ndarray:
    """At least the square roots."""
    return np.sqrt(squares.astype(np.float64)) * (1 + SLACK) + 1


def _squares(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    gap = x - entry
    return (gap * gap).sum(1)


def build_tree(entries: np.ndarray, members: tuple[int, ...] | None = None) -> Node:
    """A vantage-point tree over the rows of ``entries``; repeated entries are members like others."""
    members = tuple(range(len(entries))) if members is None else members
    if len(members) <= LEAF:
        return Node(members)
    vantage, rest = members[0], np.array(members[1:])
    far = _squares(entries[rest], entries[vantage])
    order = np.lexsort((rest, far.astype(np.float64)))
    cut = len(rest) // 2
    sides = order[:cut], order[cut:]
    halves = tuple(build_tree(entries, tuple(int(i) for i in np.sort(rest[side]))) for side in sides)
    return Node((vantage,), halves, tuple(_root_down(far[side]).min() for side in sides), tuple(_root_up(far[side]).max() for side in sides))


def nearest_entry(x: np.ndarray, entries: np.ndarray, tree: Node) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of ``entries`` to each row of integers ``x``, ties to the lower index, and its squared distance."""
    best, index = _squares(x, entries[0]), np.zeros(len(x), np.int64)

    def verify(rows: np.ndarray, entry: int) -> np.ndarray:
        far = _squares(x[rows], entries[entry])
        better = (far < best[rows]) | ((far == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = far[better], entry
        return far

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if not node.halves:
            for entry in node.members:
                verify(rows, entry)
            return
        far = verify(rows, node.members[0])
        down, up = _root_down(far), _root_up(far)

        def reached(half: int, of: np.ndarray) -> np.ndarray:
            reach = _root_up(best[rows[of]])  # an equal distance is visited too
            return rows[of[(down[of] - node.high[half] <= reach) & (node.low[half] - up[of] <= reach)]]

        inner = down <= node.high[0]
        first = np.flatnonzero(inner), np.flatnonzero(~inner)
        for half in (0, 1):
            visit(node.halves[half], reached(half, first[half]))
        for half in (0, 1):
            visit(node.halves[half], reached(half, first[1 - half]))

    visit(tree, np.arange(len(x)))
    return index, best


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part position (rows of exact integers), and where each part starts."""

    starts: tuple[int, ...]
    entries: tuple[np.ndarray, ...]
    scale: int = SCALE

    @property
    def sha256(self) -> str:
        """Hash of all entries' components in decimal, by part, entry and position."""
        numbers = ",".join(str(int(n)) for book in self.entries for entry in book for n in entry)
        return hashlib.sha256(numbers.encode()).hexdigest()

    def trees(self) -> list[Node]:
        return [build_tree(book) for book in self.entries]


def _exact(values: np.ndarray, scale: int, fits: bool) -> np.ndarray:
    """Scaled and floored: 64-bit integers where all squares fit them, else Python's."""
    floor = np.floor(values * scale)
    return floor.astype(np.int64) if fits else np.frompyfunc(int, 1, 1)(floor)


def _rows(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            cut = batch.slice(first, ROWS)
            yield cut, cut.column(at).flatten().to_numpy(zero_copy_only=False).reshape(cut.num_rows, -1)


def kept_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """``id, label, v`` of the vectors that take part, as a scratch table.

    Left out are vectors that are null or hold a null or non-finite component, or one that is ``MOST`` or more
    when scaled, and those of another length than most.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * float(scale)) < F.lit(MOST)))
    rows = materialize(rows.where(F.coalesce(finite, F.lit(False))), "kept")
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    if len(usual) < 2:
        return rows
    same = materialize(rows.where(F.size("v") == usual[0]["d"]), "kept")
    discard(rows)
    return same


def _fits(vectors: DataFrame, codebooks_starts: tuple[int, ...], width: int, scale: int) -> bool:
    """Whether every squared distance within a part, and their sum, fits 64 bits: each difference is at most twice the largest component."""
    most = vectors.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    return width * (2 * (int(most * scale) + 1)) ** 2 < 1 << 62


def fit(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codebooks | None:
    """Codebooks of a table of :func:`kept_vectors`; none if it is empty.

    A codebook starts as that part of the vectors of the ``entries`` smallest ids (a null id comes last, ties by the vector; fewer
    vectors, fewer entries). A round assigns every part and replaces each entry by the floored mean of its
    parts; an entry without any stays. A length that ``parts`` doesn't divide makes the first parts one
    component longer. Tasks send one sum per part and entry; the driver holds the codebooks alone.
    """
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not first:
        return None
    width = len(first[0]["v"])
    sizes = [width // parts + (n < width % parts) for n in range(parts)]
    starts = tuple(int(n) for n in np.concatenate(([0], np.cumsum(sizes))))
    fits = _fits(vectors, starts, width, scale)
    start = _exact(np.array([r["v"] for r in first], np.float64), scale, fits)
    books = [start[:, i:j] for i, j in zip(starts, starts[1:])]
    for _ in range(rounds):
        sums = {(r["part"], r["entry"], r["i"]): (int(r["s"]), r["n"]) for r in _sums(vectors, Codebooks(starts, tuple(books), scale), fits).collect()}
        after = []
        for part, book in enumerate(books):
            moved = book.copy()
            for entry in range(len(book)):
                for i in range(book.shape[1]):
                    if (part, entry, i) in sums:
                        total, n = sums[part, entry, i]
                        moved[entry, i] = total // n
            after.append(moved)
        if all((a == b).all() for a, b in zip(after, books)):
            break  # nothing moved: further rounds would repeat this one
        books = after
    return Codebooks(starts, tuple(books), scale)


def _sums(vectors: DataFrame, books: Codebooks, fits: bool) -> DataFrame:
    """``part, entry, i, s, n``: sum of component ``i`` and number of the parts that each entry has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        sums = [np.zeros(book.shape, object) for book in books.entries]
        counts = [np.zeros(len(book), np.int64) for book in books.entries]
        for _, values in _rows(batches, 0):
            x = _exact(values, books.scale, fits)
            for part, (i, j) in enumerate(zip(books.starts, books.starts[1:])):
                own, _ = nearest_entry(x[:, i:j], books.entries[part], trees[part])
                for entry in np.unique(own):
                    mine = own == entry
                    counts[part][entry] += int(mine.sum())
                    sums[part][entry] += np.frompyfunc(int, 1, 1)(x[mine, i:j].sum(0))
        at = [(part, entry) for part in range(len(sums)) for entry in np.flatnonzero(counts[part])]
        columns = [pa.array([p for p, _ in at], pa.int32()), pa.array([int(e) for _, e in at], pa.int32())]
        columns.append(pa.array([[Decimal(int(s)) for s in sums[p][e]] for p, e in at], pa.list_(pa.decimal128(38, 0))))
        columns.append(pa.array([int(counts[p][e]) for p, e in at], pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "sums", "n"])

    each = vectors.select("v").mapInArrow(run, "part int, entry int, sums array<decimal(38,0)>, n long")
    each = each.select("part", "entry", F.posexplode("sums").alias("i", "s"), "n")
    return each.groupBy("part", "entry", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``id, label, code, error`` of a table of :func:`kept_vectors`: entries in order of parts, two hex digits each, and the squared distance.

    An error beyond 64 bits is null.
    """
    fits = _fits(vectors, books.starts, books.starts[-1], books.scale)
    fields = [StructField("id", vectors.schema["id"].dataType), StructField("label", vectors.schema["label"].dataType)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        for batch, values in _rows(batches, 2):
            x = _exact(values, books.scale, fits)
            codes, error = np.zeros((len(x), len(trees)), np.uint8), 0
            for part, (i, j) in enumerate(zip(books.starts, books.starts[1:])):
                own, far = nearest_entry(x[:, i:j], books.entries[part], trees[part])
                codes[:, part] = own
                error = error + far
            told = pa.array([e if e < 1 << 63 else None for e in map(int, error)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([row.tobytes().hex() for row in codes]), told], names=["id", "label", "code", "error"])

    return vectors.select("id", "label", "v").mapInArrow(run, StructType([*fields, StructField("code", StringType()), StructField("error", LongType())]))


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code", out_col: str = "approximation") -> DataFrame:
    """``codes`` with the vector that each code stands for: its entries, joined and scaled back."""
    tables = F.array(*[F.array(*[F.array(*[F.lit(int(n) / books.scale) for n in entry]) for entry in book]) for book in books.entries])
    at = lambda part: F.conv(F.substring(F.col(code_col), 2 * part + 1, 2), 16, 10).cast("int")
    return codes.withColumn(out_col, F.concat(*[F.get(F.get(tables, F.lit(part)), at(part)) for part in range(len(books.entries))]))


def compress(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """Codes of all vectors under codebooks of their own: ``id, label, code, error, label_error, codebooks_sha256``.

    ``label_error`` sums the errors of equal labels, null labels together; beyond 64 bits it is null. Repeated
    rows and ids count as further rows. Vectors that are null, empty, or hold null or non-finite components
    (or such of ``MOST`` and more when scaled) are left out, and so are those of another length than most;
    without any other, the result is empty.
    Other columns are ignored. A label that many rows have is summed in parts and sent to its rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a part's code is one byte: 1 to 256 entries")
    vectors = kept_vectors(df, id_col, vec_col, label_col, scale)
    books = fit(vectors, parts, entries, rounds, scale)
    if books is None:
        books = Codebooks(tuple([0] * (parts + 1)), tuple([np.zeros((1, 0), np.int64)] * parts), scale)
    coded = encode(vectors, books)
    # a key without nulls: null labels together, apart from any text
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("key")
    coded = materialize(coded.select("*", key), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    sums = coded.groupBy("key").agg(F.when(F.count("error") == F.count(F.lit(1)), total).alias("label_error"), F.count(F.lit(1)).alias("n"))
    found = heavy_join(coded, sums, ["key"])
    return found.select("id", "label", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))

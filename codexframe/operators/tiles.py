"""Comparing the vectors of two tables group by group, in tiles of bounded size.

A group of any size is cut into tiles of rows on either side; each pair of tiles is one task's matrix product
that hands on a few rows only. So neither a large group nor an unequal pair of tables gathers in a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexframe.sources.scratch import key_join, written

#: Rows of a group that one task compares with as many others.
TILE = 4096
#: Left rows of a tile whose products are held at once.
SLAB = 512
Compare = Callable[[pa.Table, pa.Table], pa.Table]


def units(table: pa.Table, column: str = "v") -> np.ndarray:
    """A list column of equal lengths as unit rows; a zero vector becomes NaN."""
    flat = table.column(column).combine_chunks()
    m = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, size, out=np.full_like(m, np.nan), where=size > 0)


def cosines(x: pa.Table, y: pa.Table, digits: int | None = None) -> np.ndarray:
    """Cosine of each row of ``x`` and each of ``y``; minus infinity where there is none."""
    near = units(x) @ units(y).T
    near = near if digits is None else near.round(digits)
    return np.where(np.isnan(near), -np.inf, near)


def prepared(rows: DataFrame, group: str, id_col: str, vec_col: str, *more: str) -> DataFrame:
    """``g, d, id, v`` and further columns of the rows that have all of them; ``d`` is the vector's length."""
    v = F.col(vec_col).cast("array<double>")
    base = rows.select(F.col(group).alias("g"), F.size(v).alias("d"), F.col(id_col).alias("id"), v.alias("v"), *more)
    return base.where("g is not null and id is not null and v is not null and d > 0")


def meet(left: DataFrame, right: DataFrame, compare: Compare, schema: str, tile: int = TILE) -> DataFrame:
    """``compare`` over all pairs of tiles of the groups that both tables of :func:`prepared` rows have.

    It is given ``SLAB`` left rows of a tile at a time, and must judge each left row by itself. Vectors of different lengths never meet.
    """
    key = ["g", "d"]
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own where both are one table
    count = lambda rows, name: rows.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    sizes = written(count(left, "l").join(count(right, "r"), key), "groups")
    blocks = lambda c: F.ceil(F.col(c) / tile).cast("int")

    def dealt(rows: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        there = sizes.select(*key, F.col(own).alias("n"), blocks(own).alias("here"), blocks(other).alias("there"))
        place = F.pmod(F.xxhash64("id"), F.col("here")).cast("int").alias(names[0])
        many = F.explode(F.sequence(F.lit(0), F.col("there") - 1)).alias(names[1])
        return key_join(rows, there, key).select(*rows.columns, place, many)

    mine, theirs = dealt(left, "l", "r", ("a", "b")), dealt(right, "r", "l", ("b", "a"))
    by = ["g", "d", "a", "b"]

    def stepped(x: pa.Table, y: pa.Table) -> pa.Table:
        return pa.concat_tables([compare(x.slice(at, SLAB), y) for at in range(0, max(x.num_rows, 1), SLAB)])

    return mine.groupBy(*by).cogroup(theirs.groupBy(*by)).applyInArrow(stepped, schema)


def nearest(left: DataFrame, right: DataFrame, k: int, itself: bool = True, digits: int | None = None, tile: int = TILE) -> DataFrame:
    """Each left row's ``k`` most similar right rows of its group: ``g, id, other_id, score, rank``, ties to the smaller id.

    ``itself`` tells whether a row of the same id counts. Ids are told apart within a group. Rows with a zero vector take no part.
    """
    kinds = dict(left.dtypes), dict(right.dtypes)

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"g": x.column("g")[:0], "id": x.column("id")[:0], "other_id": y.column("id")[:0], "score": np.zeros(0)})
        y = y.sort_by("id")
        near = cosines(x, y, digits)
        if not itself:
            near[np.equal.outer(np.array(x.column("id").to_pylist(), object), np.array(y.column("id").to_pylist(), object))] = -np.inf
        if near.shape[1] > k:
            least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            row, at = np.nonzero((near >= least[:, None]) & np.isfinite(near))
        else:
            row, at = np.nonzero(np.isfinite(near))
        score = near[row, at]
        order = np.lexsort((at, -score, row))  # y is in order of id
        row, at, score = row[order], at[order], score[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        take = lambda t, c, i: t.column(c).take(pa.array(i[keep], pa.int64()))
        return pa.table({"g": take(x, "g", row), "id": take(x, "id", row), "other_id": take(y, "id", at), "score": score[keep]})

    schema = f"g {kinds[0]['g']}, id {kinds[0]['id']}, other_id {kinds[1]['id']}, score double"
    found = meet(left, right, compare, schema, tile)
    place = Window.partitionBy("g", "id").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)

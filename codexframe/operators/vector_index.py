"""A stored vector index: cells on disk, of which a search reads a few.

The index is built once. Each vector is stored in the cells of its nearest centres, one folder a cell, so a
search turns its nearest cells into a partition filter and the other cells' files are never opened.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexframe.functions.vectors import cosine, is_valid, norm
from codexframe.operators import tiles
from codexframe.sources.layout import drop_partitions

#: Rows that centres are fitted on at most; the most centres; cells that hold a vector.
SAMPLE, MOST_CELLS, COPIES = 50_000, 4096, 2
#: Share of the cells that a search reads if it names no number.
PROBED = 0.3


def cell_count(rows: int) -> int:
    """About one and a half times the square root of the rows, so that centres and cells grow alike."""
    return max(1, min(MOST_CELLS, int(1.5 * rows**0.5)))


def fit_centres(x: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Unit centres: the first ``cells`` rows of unit vectors, moved by ``rounds`` of spherical k-means; an empty one stays."""
    centres = x[:cells].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[at : at + 8192] @ centres.T).argmax(1) for at in range(0, len(x), 8192)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def _nearest_cells(centres: np.ndarray, copies: int):
    """An Arrow function from vector to its nearest cells, nearest first, ties to the smaller number."""

    @F.pandas_udf("array<int>")
    def run(vectors: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(vectors), 4096):
            m = np.stack([np.asarray(v, np.float64) for v in vectors[at : at + 4096]])
            near = m @ centres.T
            out += list(np.argsort(-near, axis=1, kind="stable")[:, :copies].astype(np.int32))
        return pd.Series(out)

    return run


@dataclass(frozen=True)
class VectorIndex:
    """An index below ``path``: ``centres`` (one row a cell) and ``cells`` (one folder a cell)."""

    spark: SparkSession
    path: str
    id_col: str
    vec_col: str
    centres: np.ndarray
    copies: int

    @classmethod
    def build(
        cls,
        vectors: DataFrame,
        path: str,
        id_col: str,
        vec_col: str = "embedding",
        cells: int | None = None,
        copies: int = COPIES,
        rounds: int = 8,
        sample: int = SAMPLE,
    ) -> VectorIndex:
        """Write an index of all ``vectors``: their columns, with unique ids.

        Centres are fitted on the ``sample`` rows of the smallest hashed ids at most; every row is indexed. Vectors that
        are null, zero, not finite, or of another length than the first of the sample take no part.
        """
        spark, usable = vectors.sparkSession, _usable(vectors, vec_col)
        hashed = F.md5(F.col(id_col).cast("string"))
        taught = usable.orderBy(hashed, id_col).limit(sample).select(F.col(vec_col).cast("array<double>").alias("v")).toPandas()["v"]
        size = len(taught[0]) if len(taught) else 1
        x = np.stack([v for v in taught if len(v) == size]) if len(taught) else np.zeros((0, 1))
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        cells = min(len(x), cells or cell_count(usable.count()))
        centres = fit_centres(x, cells, rounds) if cells else x
        rows = [(n, c.tolist()) for n, c in enumerate(centres)]
        table = spark.createDataFrame(rows, "cell int, centre array<double>").withColumns({"id_col": F.lit(id_col), "vec_col": F.lit(vec_col), "copies": F.lit(copies)})
        table.coalesce(1).write.parquet(f"{path}/centres")
        index = cls(spark, path, id_col, vec_col, centres, copies)
        index._write(usable, "errorifexists")
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        """An index that was built before."""
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").limit(MOST_CELLS).collect()
        centres = np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 1))
        names = (rows[0]["id_col"], rows[0]["vec_col"], rows[0]["copies"]) if rows else ("id", "embedding", COPIES)
        return cls(spark, path, names[0], names[1], centres, names[2])

    def _write(self, usable: DataFrame, mode: str) -> None:
        if not len(self.centres):
            usable = usable.limit(0)
        fits = usable.where(F.size(self.vec_col) == self.centres.shape[1])
        rows = self.assigned(fits)
        # ranges of cell and id: a large cell is written by several tasks, in files that ids can skip
        rows.repartitionByRange("cell", self.id_col).write.mode(mode).partitionBy("cell").parquet(f"{self.path}/cells")

    def assigned(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` once for each of their cells: ``place`` (0 for the nearest) and ``cell``."""
        near = _nearest_cells(self.centres, min(self.copies, len(self.centres)))(F.col(self.vec_col).cast("array<double>"))
        return vectors.select("*", F.posexplode(near).alias("place", "cell"))

    def rows(self) -> DataFrame:
        """All stored rows, a vector as often as it has cells, with ``place`` and ``cell``."""
        return self.spark.read.parquet(f"{self.path}/cells")

    def append(self, vectors: DataFrame) -> None:
        """Add vectors of new ids; the centres stay."""
        self._write(_usable(vectors, self.vec_col), "append")

    def delete(self, ids: DataFrame) -> None:
        """Take out the rows of these ids (one column). Only the cells that hold one are written anew."""
        gone = ids.select(F.col(ids.columns[0]).alias(self.id_col)).distinct()
        held = self.rows().select(self.id_col, "cell").join(gone, self.id_col, "left_semi")
        touched = [r["cell"] for r in held.select("cell").distinct().collect()]  # as many as there are cells at most
        if not touched:
            return
        left = self.rows().where(F.col("cell").isin(touched)).join(gone, self.id_col, "left_anti")
        fresh = f"{self.path}/_next-{uuid.uuid4().hex}"
        left.write.partitionBy("cell").parquet(fresh)
        kept = self.spark.read.schema(self.rows().schema).parquet(fresh)
        kept.repartitionByRange("cell", self.id_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{self.path}/cells")
        full = {r["cell"] for r in kept.select("cell").distinct().collect()}
        drop_partitions(self.spark, f"{self.path}/cells", [f"cell={c}" for c in touched if c not in full])
        drop_partitions(self.spark, self.path, [fresh.rsplit("/", 1)[1]])

    def probed(self, query: list[float], probes: int | None = None) -> list[int]:
        """The cells nearest to a query; ``PROBED`` of all of them if no number is given."""
        probes = probes or max(1, int(len(self.centres) * PROBED))
        near = self.centres @ np.asarray(query, np.float64)
        return [int(c) for c in np.argsort(-near, kind="stable")[:probes]]

    def search(self, query: list[float], k: int, probes: int | None = None, where: Column | None = None) -> DataFrame:
        """The ``k`` rows most like one query among those of the probed cells that pass ``where``, with their cosine ``score``.

        The cells are a partition filter, so only their files are read; ``where`` is pushed to those. Ties to the smaller id.
        """
        if len(query) != self.centres.shape[1]:
            return self.rows().limit(0).drop("cell", "place").withColumn("score", F.lit(0.0)) if len(self.centres) else self.spark.createDataFrame([], "score double")
        cells = self.probed(query, probes)
        near = self.rows().where(F.col("cell").isin(cells))
        near = near if where is None else near.where(where)
        q = F.array(*[F.lit(float(x)) for x in query])
        scored = near.withColumn("score", cosine(F.col(self.vec_col), q))
        # a vector's copies are equal, so k copies of each rank hold the k vectors
        best = scored.orderBy(F.desc("score"), self.id_col).limit(k * self.copies)
        once = Window.partitionBy(self.id_col).orderBy("place")
        best = best.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n", "cell", "place")
        return best.orderBy(F.desc("score"), self.id_col).limit(k)

    def search_many(self, queries: DataFrame, id_col: str, k: int, probes: int | None = None, vec_col: str | None = None) -> DataFrame:
        """Each query row's ``k`` most similar rows of its probed cells: ``query_id, rank, id, score``; a row of the same id counts.

        Queries and rows meet cell by cell, in tiles.
        """
        probes = probes or max(1, int(len(self.centres) * PROBED))
        vec = vec_col or self.vec_col
        asked = _usable(queries, vec).where(F.size(vec) == self.centres.shape[1])
        near = _nearest_cells(self.centres, min(probes, len(self.centres)))(F.col(vec).cast("array<double>"))
        sent = asked.select(F.col(id_col), F.col(vec), F.explode(near).alias("cell"))
        found = tiles.nearest(tiles.prepared(sent, "cell", id_col, vec), tiles.prepared(self.rows(), "cell", self.id_col, self.vec_col), k)
        once = found.groupBy("id", "other_id").agg(F.max("score").alias("score"))
        place = Window.partitionBy("id").orderBy(F.desc("score"), "other_id")
        best = once.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        return best.select(F.col("id").alias("query_id"), "rank", F.col("other_id").alias("id"), "score")


def _usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    return vectors.where(is_valid(v) & (F.size(v) > 0) & F.coalesce(norm(v) > 0, F.lit(False)))

"""Tables laid out in buckets of a key, so that reads and writes of one key touch one bucket's files.

A bucket is a folder, chosen by the key's hash. A read of given keys is a partition filter; a write finds the
buckets that hold a changed row, and writes only those anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexframe.operators import dml

BUCKET = "_bucket"


def drop_partitions(spark: SparkSession, path: str, names: list[str]) -> None:
    """Delete folders of a table that hold no rows any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in names:
        fs.delete(hadoop(f"{path}/{name}"), True)


@dataclass(frozen=True)
class BucketedTable:
    """A Parquet table below ``path`` in ``buckets`` folders of one key column.

    A null key has a bucket of its own hash like any other. A statement reads the buckets it touches,
    writes their new rows beside the table, and then replaces these buckets' folders; other folders keep their files.
    One writer at a time; a write that is cut short before the replacement changes nothing.
    """

    spark: SparkSession
    path: str
    key: str
    buckets: int

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> BucketedTable:
        """Write the whole table. Ranges of bucket and key: a bucket with a hot key is written by several tasks."""
        placed = rows.withColumn(BUCKET, self._bucket(F.col(self.key)))
        placed.repartitionByRange(BUCKET, self.key).write.mode("errorifexists").partitionBy(BUCKET).parquet(self.path)
        return self

    def rows(self) -> DataFrame:
        """All rows."""
        return self.spark.read.parquet(self.path).drop(BUCKET)

    def of(self, *keys: Any) -> DataFrame:
        """The rows of these keys, by a filter on the folder and on the column; other folders aren't opened."""
        table = self.spark.read.parquet(self.path)
        kind = table.schema[self.key].dataType
        values = [F.lit(k).cast(kind) for k in keys]
        return table.where(F.col(BUCKET).isin([self._bucket(v) for v in values]) & F.col(self.key).isin(values)).drop(BUCKET)

    def of_all(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys in a table's first column: folders are pruned when the keys are known, at run time."""
        table = self.spark.read.parquet(self.path)
        asked = keys.select(F.col(keys.columns[0]).alias(self.key)).distinct().withColumn(BUCKET, self._bucket(F.col(self.key)))
        return table.join(asked, [BUCKET, self.key], "left_semi").drop(BUCKET)

    def _touched(self, marked: DataFrame) -> list[int]:
        return sorted(r[0] for r in marked.select(BUCKET).distinct().collect())  # at most as many as there are buckets

    def _rewrite(self, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replace the touched buckets by ``change`` of their rows; returns the buckets that were written."""
        if not touched:
            return []
        whole = self.spark.read.parquet(self.path)
        after = change(whole.where(F.col(BUCKET).isin(touched)).drop(BUCKET)).withColumn(BUCKET, self._bucket(F.col(self.key)))
        name = f"_next-{uuid.uuid4().hex}"
        beside = f"{self.path.rstrip('/')}{name}"
        after.write.partitionBy(BUCKET).parquet(beside)
        fresh = self.spark.read.schema(whole.schema).parquet(beside)
        full = self._touched(fresh)
        if full:
            ready = fresh.repartitionByRange(BUCKET, self.key)
            ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        drop_partitions(self.spark, self.path, [f"{BUCKET}={b}" for b in touched if b not in full])
        folder, _, last = beside.rpartition("/")
        drop_partitions(self.spark, folder, [last])
        return sorted({*touched, *full})

    def _buckets_of(self, rows: DataFrame) -> list[int]:
        return self._touched(rows.select(self._bucket(F.col(self.key)).alias(BUCKET)))

    def _matching(self, where: Column) -> list[int]:
        return self._touched(self.spark.read.parquet(self.path).where(F.coalesce(where, F.lit(False))))

    def update(self, where: Column, changes: dict[str, Any]) -> list[int]:
        """:func:`dml.update` of the buckets that hold a matching row. The key itself can't be changed here."""
        if self.key in changes:
            raise ValueError("a row's key decides its bucket; delete the row and insert it again")
        return self._rewrite(self._matching(where), lambda rows: dml.update(rows, where, changes))

    def delete(self, where: Column) -> list[int]:
        """:func:`dml.delete` of the buckets that hold a matching row."""
        return self._rewrite(self._matching(where), lambda rows: dml.delete(rows, where))

    def delete_keys(self, keys: DataFrame) -> list[int]:
        """Rows of the keys in a table's first column go, as children go with their parents."""
        gone = keys.select(F.col(keys.columns[0]).alias(self.key)).distinct()
        return self._rewrite(self._buckets_of(gone), lambda rows: dml.delete_keys(rows, gone, self.key))

    def upsert(self, rows: DataFrame, on: list[str], changes: list[str] | None = None) -> list[int]:
        """:func:`dml.upsert` into the buckets of the given rows; the key must be one of ``on``."""
        if self.key not in on:
            raise ValueError("rows are found by bucket, so the key must be among the columns they are matched on")
        return self._rewrite(self._buckets_of(rows), lambda had: dml.upsert(had, rows, on, changes))

    def insert(self, rows: DataFrame) -> None:
        """Add rows; no file that exists is touched."""
        placed = rows.withColumn(BUCKET, self._bucket(F.col(self.key)))
        placed.repartitionByRange(BUCKET, self.key).write.mode("append").partitionBy(BUCKET).parquet(self.path)

    def replace_children(self, fresh: DataFrame) -> list[int]:
        """:func:`dml.replace_children`: the keys that ``fresh`` covers have its rows only."""
        return self._rewrite(self._buckets_of(fresh), lambda had: dml.replace_children(had, fresh, self.key))

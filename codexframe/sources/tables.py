"""Parquet tables in versioned snapshots: several tables change together or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codexframe.schemas import TABLES


class SnapshotStore:
    """Tables under one path; the pointer file of the highest number names the versions that readers see.

    A commit writes whole new versions of the tables it changes, then a new pointer, and renames that to
    the next number. Nothing that readers may hold is deleted, so a reader at any moment sees the state before or
    after. If another writer took the number first, the rename fails and nothing of this commit shows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _number(self) -> int:
        """The number of the last commit; 0 before the first."""
        if not self._fs.exists(self._path("")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(""))]
        return max((int(n.removeprefix("CURRENT-")) for n in names if n.startswith("CURRENT-")), default=0)

    def _versions(self, number: int) -> dict[str, str]:
        if not number:
            return {}
        rows = self.spark.read.text(f"{self.path}/CURRENT-{number:012d}").collect()
        return dict(r["value"].split("\t", 1) for r in rows if r["value"])

    def versions(self) -> dict[str, str]:
        """Table to folder of its current version."""
        return self._versions(self._number())

    def read(self, table: str) -> DataFrame:
        """The current rows; a known table that was never written is empty."""
        at = self.versions().get(table)
        if at is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.parquet(f"{self.path}/{at}")

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Write new versions and switch to all of them at once."""
        version, number = uuid.uuid4().hex, self._number()
        now = self._versions(number)
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{name}/{version}")
            now[name] = f"{name}/{version}"
        out = self._fs.create(self._path(f"_next.{version}"))
        out.write(bytearray("".join(f"{k}\t{v}\n" for k, v in sorted(now.items())).encode()))
        out.close()
        at = self._path(f"CURRENT-{number + 1:012d}")
        if self._fs.exists(at) or not self._fs.rename(self._path(f"_next.{version}"), at):
            raise OSError("another writer has committed; nothing was changed")


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Parquet tables of a folder by name."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}

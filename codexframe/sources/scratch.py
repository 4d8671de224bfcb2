"""Intermediate tables in the folder that driver and executors share, and joins that hot keys don't gather."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that at least one in so many of all rows have are sent to the rows; there are at most as many of them.
HEAVY = 1000


@lru_cache(1)
def _own_folder() -> str:
    """A folder of this process on its one machine, gone when it ends."""
    path = tempfile.mkdtemp(prefix="codexframe-tables-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_folder(spark: SparkSession) -> str:
    """Where scratch tables go: below ``spark.checkpoint.dir``; on one machine, a folder of our own if that isn't set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _own_folder()
    return f"{named.rstrip('/')}/codexframe-tables/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back: the lineage ends here, and what a task numbered stays as written."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_join(rows: DataFrame, by_key: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``by_key``, a written table of one row a key without nulls, whose ``n`` counts the rows that have it.

    Keys of more than a share of ``1 / HEAVY`` are sent to the rows, so no key's rows are gathered in a task.
    """
    total = by_key.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(by_key.where(F.col("n") * HEAVY >= total).drop("n"))
    light = by_key.where(F.col("n") * HEAVY < total).drop("n")
    rest = rows.join(heavy, on, "left_anti").join(light, on)
    return rows.join(heavy, on).unionByName(rest)

"""Shared pieces of the training-data operators: scratch tables and the word definition."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"

_OWN_ROOT: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none, on one machine (a test), a folder of our own is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "root" not in _OWN_ROOT:
        _OWN_ROOT["root"] = tempfile.mkdtemp(prefix="codexframe-")
        atexit.register(shutil.rmtree, _OWN_ROOT["root"], ignore_errors=True)
    return f"file://{_OWN_ROOT['root']}"


def _run_folder(spark: SparkSession) -> str:
    """This application's folder of scratch tables."""
    return f"{scratch_root(spark)}/codexframe/{spark.sparkContext.applicationId}"


#: Rows that a file of a scratch table should hold at least.
ROWS_PER_FILE = 50_000


#: Spark's own setting: remove an execution's shuffle files when it ends.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Executions planned here remove their shuffle files when they end; the session's own choice holds again afterwards."""
    before = spark.conf.get(REMOVE_SHUFFLES, "false")
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    ``rows``, about as many as there are, keeps a small table from becoming many more files than there
    are cores to write them.

    This cuts the lineage: a lost executor costs no recomputation of what was written, and what a
    nondeterministic task (a row number by partition) gave stays as written. Shuffle files of the write
    go when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{_run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FILE)))
    with _shuffles_removed(spark):
        df.select("*").write.parquet(path)  # a new plan, so that it takes the setting
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path  # type: ignore[attr-defined]
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`materialize` that no later step reads."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def word_array(text: Column) -> Column:
    """Words of ``text``; null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.array_remove(parts, "")


def word_count(text: Column) -> Column:
    """Number of words of ``text`` as a long; null text has none."""
    return F.size(word_array(text)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that only a few texts at a time exist as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def clean_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this application, no other's; results that still read them must be written before."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    where.getFileSystem(conf).delete(where, True)


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a scratch table; decides whether it may be broadcast."""
    path = getattr(df, "scratch_path", None)
    if path is None:
        raise ValueError("only a table made by materialize() has a known size")
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return int(where.getFileSystem(conf).getContentSummary(where).getLength())


#: A key table of so few rows, and so few bytes on disk, is sent to every executor; a larger one is joined by a shuffle.
SENT_ROWS, SENT_BYTES = 200_000, 4 << 20


def keyed(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """``rows`` joined (``how``) with ``keys``, a scratch table of short columns; nulls of ``on`` equal nulls."""
    small = table_bytes(keys) <= SENT_BYTES and keys.count() <= SENT_ROWS
    met = F.expr(" and ".join(f"x.{c} <=> y.{c}" for c in on))
    more = [] if how in ("left_anti", "left_semi") else [F.col(f"y.{c}") for c in keys.columns if c not in on]
    return rows.alias("x").join((F.broadcast(keys) if small else keys).alias("y"), met, how).select("x.*", *more)


#: Keys that at least one in so many of all rows have; there are at most as many of them.
HEAVY = 1000


def heavy_join(rows: DataFrame, by_key: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``by_key``, one row a key without nulls, whose ``n`` tells how many of the rows have the key.

    Keys that many rows have, ``HEAVY`` at most by count, are sent to the rows; only the others meet in a
    shuffle. So no key's rows are gathered in one task, whatever its share.
    """
    keys = materialize(by_key, "by_key")
    total = keys.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(keys.where(F.col("n") * HEAVY >= total).drop("n"))
    light = keys.where(F.col("n") * HEAVY < total).drop("n")
    rest = rows.join(heavy, on, "left_anti").join(light, on)
    return rows.join(heavy, on).unionByName(rest)


def worker_cache() -> dict:
    """A dict that lives as long as the Python process, also where this package travels by value."""
    import sys

    return sys.__dict__.setdefault("_codexframe_cache", {})

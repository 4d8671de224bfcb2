"""Continuous ingest: files that arrive go through the pipeline in micro-batches.

The checkpoint makes the background work durable: a batch that a crash cut off runs again, and because
chunks replace those of their documents, running it twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from codexframe.plans.jobs import run_pipeline
from codexframe.sources.files import read_files


def ingest(spark: SparkSession, inbox: str, out: str, checkpoint: str, embedder, dim: int) -> StreamingQuery:
    """Watch ``inbox`` and append documents, chunks and jobs below ``out``, partitioned by batch."""

    def handle(batch: DataFrame, number: int) -> None:
        for name, rows in run_pipeline(batch, embedder, dim).items():
            # the batch's own partition is overwritten, so a repeated batch leaves one copy
            rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}")

    stream = read_files(spark, inbox, stream=True)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_progress(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events of jobs (``ts, event_type, value``) per window and type, late ones up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

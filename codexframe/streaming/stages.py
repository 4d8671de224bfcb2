"""The stages of each document as keyed stream state: every change of status as it happens, and stuck jobs by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codexframe.schemas import JOB_TYPE
from codexframe.sources.scratch import new_path

#: What an event makes of its document: READY comes with the vectors, before the analysis, and outlives its failure.
STATUS = {
    ("EXTRACT_TEXT", "STARTED"): "EXTRACTING",
    ("EXTRACT_TEXT", "COMPLETED"): "EXTRACTED",
    ("EXTRACT_TEXT", "FAILED"): "FAILED",
    ("CHUNK_DOCUMENT", "STARTED"): "EXTRACTED",
    ("CHUNK_DOCUMENT", "COMPLETED"): "EXTRACTED",
    ("CHUNK_DOCUMENT", "FAILED"): "EXTRACTED",
    ("EMBED_DOCUMENT", "STARTED"): "EXTRACTED",
    ("EMBED_DOCUMENT", "COMPLETED"): "READY",
    ("EMBED_DOCUMENT", "FAILED"): "EXTRACTED",
    ("ANALYZE_DOCUMENT", "STARTED"): "ANALYZING",
    ("ANALYZE_DOCUMENT", "COMPLETED"): "READY",
    ("ANALYZE_DOCUMENT", "FAILED"): "READY",
}
_OUT = "document_id string, us long, stage string, status string, attempts int, message string"
#: The state of a group of documents: a list per column, one place a document.
_STATE = "document_id array<string>, stage array<string>, status array<string>, attempts array<int>, running array<boolean>, since array<long>"
_NEW = (JOB_TYPE[0], "UPLOADED", 0, False, 0)


def track(events: DataFrame, limit_ms: int = 3_600_000, late: str = "10 minutes", groups: int = 4096) -> DataFrame:
    """Status changes of documents from a stream of ``document_id, ts, stage, outcome, message, n``.

    ``outcome`` is STARTED, COMPLETED or FAILED; without a ``stage`` an event is of the document's present one, at first
    EXTRACT_TEXT. Events of a micro-batch are taken in order of ``ts, n``. A row is emitted for each start and each
    change of status, ``attempts`` counting the starts. A job that has started and then says nothing for ``limit_ms`` of event time
    fails with a message of its own. Events later than the watermark (``late``) or of no document, time or known outcome are left out.

    A Python call takes the documents of one of ``groups`` groups by hash, since a call costs far more than a document.
    A group's state holds a few values a document and is written anew when any of them has events; its events of one
    micro-batch are held at once, and the source's ``maxFilesPerTrigger`` bounds a batch. ``groups`` stays as it was
    for all runs with a checkpoint.
    """
    known = F.col("document_id").isNotNull() & F.col("outcome").isin("STARTED", "COMPLETED", "FAILED")
    known = known & F.col("ts").isNotNull() & (F.col("stage").isNull() | F.col("stage").isin(*JOB_TYPE))
    message = F.when(F.col("outcome") == "FAILED", F.col("message").cast("string")).alias("message")
    given = events.where(known).select(F.col("document_id").cast("string").alias("document_id"), "ts", "stage", "outcome", message, "n", F.unix_micros("ts").alias("us"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {document: own for document, *own in zip(*state.get)} if state.exists else {}
        out: list[tuple] = []

        def expire(document: str, stage: str, attempts: int, since: int) -> str:
            status = STATUS[stage, "FAILED"]
            out.append((document, (since + limit_ms) * 1000, stage, status, attempts, "no answer in time"))
            return status

        if not state.hasTimedOut:
            rows = pd.concat(frames).sort_values(["us", "n"])
            for document, us, own, outcome, message in zip(*(rows[name].tolist() for name in ("document_id", "us", "stage", "outcome", "message"))):
                stage, status, attempts, running, since = held.get(document, _NEW)
                now = us // 1000
                if running and now >= since + limit_ms:
                    status = expire(document, stage, attempts, since)
                stage = own or stage
                before, status = status, STATUS[stage, outcome]
                running = outcome == "STARTED"
                attempts += running
                if running or status != before or outcome == "FAILED":
                    out.append((document, us, stage, status, attempts, message))
                held[document] = (stage, status, attempts, running, now)
        waiting = []
        for document, (stage, _, attempts, running, since) in held.items():
            if running and since + limit_ms <= state.getCurrentWatermarkMs():
                held[document] = (stage, expire(document, stage, attempts, since), attempts, False, since)
            elif running:
                waiting.append(since)
        state.update(tuple(map(list, zip(*((document, *own) for document, own in held.items())))))
        if waiting:
            state.setTimeoutTimestamp(min(waiting) + limit_ms)
        yield pd.DataFrame(out, columns=["document_id", "us", "stage", "status", "attempts", "message"]).astype({"us": "int64", "attempts": "int32"})

    keyed = given.withColumn("documents", F.pmod(F.xxhash64("document_id"), F.lit(groups))).withWatermark("ts", late).groupBy("documents")
    changes = keyed.applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return changes.select("document_id", F.timestamp_micros("us").alias("ts"), "stage", "status", "attempts", "message")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now, and read what all its runs with this ``checkpoint`` have written below ``out``.

    A micro-batch has a folder of its own, which a repeated batch writes anew, so a crash leaves no row twice.
    In ``complete`` mode the last batch holds the whole result and the only folder left.
    """

    def write(batch: DataFrame, number: int) -> None:
        at = number if mode == "append" else 0
        batch.write.mode("overwrite").parquet(f"{out}/batch={at}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/batch=*")


def latest_status(changes: DataFrame) -> DataFrame:
    """Each document's last change."""
    last = F.max(F.struct("ts", "attempts", "stage", "status", "message")).alias("last")
    return changes.groupBy("document_id").agg(last).select("document_id", "last.ts", "last.stage", "last.status", "last.attempts", "last.message")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream, with the schema that its files have."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name a file as well as a folder


def scratch_run(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """:func:`run_available` with fresh folders in the shared scratch folder."""
    at = new_path(stream.sparkSession, label)
    return run_available(stream, f"{at}/out", f"{at}/checkpoint", mode)

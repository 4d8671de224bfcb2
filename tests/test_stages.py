"""Stages of documents as stream state: order, restarts and timers."""

from __future__ import annotations

import datetime
import random

from codexframe.streaming import stages

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "document_id string, ts timestamp, stage string, outcome string, message string, n long"


def at(minutes: float) -> datetime.datetime:
    return T0 + datetime.timedelta(minutes=minutes)


FIRST = [
    ("a", at(0), "EXTRACT_TEXT", "STARTED", None, 1), ("a", at(1), None, "COMPLETED", None, 2), ("a", at(2), "CHUNK_DOCUMENT", "STARTED", None, 3), ("a", at(3), None, "COMPLETED", None, 4),
    ("a", at(4), "EMBED_DOCUMENT", "STARTED", None, 5), ("b", at(0), "EXTRACT_TEXT", "STARTED", None, 6), ("b", at(5), None, "FAILED", "no text", 7), ("c", at(1), "ANALYZE_DOCUMENT", "STARTED", None, 8),
    (None, at(1), "EXTRACT_TEXT", "STARTED", None, 9), ("d", at(1), "EXTRACT_TEXT", "ODD", None, 10), ("e", at(2), "EXTRACT_TEXT", "STARTED", None, 11),
]
SECOND = [
    ("a", at(20), None, "COMPLETED", None, 12), ("a", at(21), "ANALYZE_DOCUMENT", "STARTED", None, 13), ("a", at(22), None, "FAILED", "no reply", 14),
    ("b", at(25), "EXTRACT_TEXT", "STARTED", None, 15), ("b", at(26), None, "COMPLETED", None, 16), ("z", at(200), "EXTRACT_TEXT", "STARTED", None, 17),
]


def run(spark, folder, rows, number):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = stages.track(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), limit_ms=3_600_000)
    return stages.run_available(stream, f"{folder}/out", f"{folder}/checkpoint")


def test_changes_survive_a_restart_and_stuck_jobs_end(spark, tmp_path):
    rows = run(spark, str(tmp_path), FIRST, 0).collect()
    mine = lambda found, d: [(r.stage, r.status, r.attempts, r.message) for r in sorted(found, key=lambda r: (r.ts, r.attempts)) if r.document_id == d]
    first = [("EXTRACT_TEXT", "EXTRACTING", 1, None), ("EXTRACT_TEXT", "EXTRACTED", 1, None), ("CHUNK_DOCUMENT", "EXTRACTED", 2, None), ("EMBED_DOCUMENT", "EXTRACTED", 3, None)]
    assert mine(rows, "a") == first
    assert mine(rows, "b") == [("EXTRACT_TEXT", "EXTRACTING", 1, None), ("EXTRACT_TEXT", "FAILED", 1, "no text")]
    assert {r.document_id for r in rows} == {"a", "b", "c", "e"}
    # another run with the same checkpoint goes on where the first one ended
    rows = run(spark, str(tmp_path), SECOND, 1).collect()
    assert mine(rows, "a") == [*first, ("EMBED_DOCUMENT", "READY", 3, None), ("ANALYZE_DOCUMENT", "ANALYZING", 4, None), ("ANALYZE_DOCUMENT", "READY", 4, "no reply")]
    assert mine(rows, "b")[2:] == [("EXTRACT_TEXT", "EXTRACTING", 2, None), ("EXTRACT_TEXT", "EXTRACTED", 2, None)]
    # what said nothing for an hour of event time has failed
    assert mine(rows, "c") == [("ANALYZE_DOCUMENT", "ANALYZING", 1, None), ("ANALYZE_DOCUMENT", "READY", 1, "no answer in time")]
    assert mine(rows, "e")[1:] == [("EXTRACT_TEXT", "FAILED", 1, "no answer in time")]
    assert mine(rows, "z") == [("EXTRACT_TEXT", "EXTRACTING", 1, None)]
    last = {r.document_id: (r.status, r.attempts) for r in stages.latest_status(spark.createDataFrame(rows)).collect()}
    assert last == {"a": ("READY", 4), "b": ("EXTRACTED", 2), "c": ("READY", 1), "e": ("FAILED", 1), "z": ("EXTRACTING", 1)}


def test_a_batch_that_ran_twice_leaves_its_rows_once(spark, tmp_path):
    n = run(spark, str(tmp_path), FIRST, 0).count()
    assert run(spark, str(tmp_path), [], 1).count() == n


def plainly(rows, limit, mark):
    """The changes of each document, one event after the other, with all of them at hand."""
    found, held = [], {}
    for document, ts, own, outcome, message, _ in sorted(rows, key=lambda r: (r[1], r[5])):
        stage, status, attempts, since = held.get(document, ("EXTRACT_TEXT", "UPLOADED", 0, None))
        if since is not None and ts >= since + limit:
            status = stages.STATUS[stage, "FAILED"]
            found.append((document, since + limit, stage, status, attempts, "no answer in time"))
        stage = own or stage
        before, status = status, stages.STATUS[stage, outcome]
        since, attempts = (ts, attempts + 1) if outcome == "STARTED" else (None, attempts)
        if outcome != "COMPLETED" or status != before:
            found.append((document, ts, stage, status, attempts, message if outcome == "FAILED" else None))
        held[document] = (stage, status, attempts, since)
    for document, (stage, _, attempts, since) in held.items():
        if since is not None and since + limit <= mark:
            found.append((document, since + limit, stage, stages.STATUS[stage, "FAILED"], attempts, "no answer in time"))
    return sorted(found, key=str)


def test_documents_share_calls_and_state_rows(spark, tmp_path):
    draw = random.Random(3)
    event = lambda n, start: (f"d{draw.randrange(200)}", at(start + draw.randrange(18_000) / 60), draw.choice([None, None, *stages.JOB_TYPE]), draw.choice(["STARTED", "STARTED", "COMPLETED", "FAILED"]), f"m{n}", n)
    rounds = [[event(n, 0) for n in range(1500)], [event(n, 300) for n in range(1500, 2500)]]
    for rows in rounds:  # the second goes on from the state of the first
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stages.track(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), limit_ms=3_600_000, groups=8)
        write = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint")
        query = write.trigger(availableNow=True).start()
        query.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert held and max(held) <= 8  # calls and rows of state don't grow with the documents
    rows = rounds[0] + rounds[1]
    want = plainly(rows, datetime.timedelta(hours=1), max(r[1] for r in rows) - datetime.timedelta(minutes=10))
    assert sum(r[5] == "no answer in time" for r in want) > 100
    assert sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=str) == want

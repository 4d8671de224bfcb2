"""Session settings that the engine assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings worth having at any size; partition counts are left to the cluster and the adaptive planner.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str | None = None, app: str = "codexframe", **more: str) -> SparkSession:
    """A session with :data:`SETTINGS`, then ``more``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

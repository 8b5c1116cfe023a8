"""Session settings that the queries count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "caselight", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings are the caller's."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()

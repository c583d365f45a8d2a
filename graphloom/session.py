"""The session settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Duplicate JSON keys keep the last, so do merged maps; times are UTC.
SETTINGS = {
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
}


def configured(spark: SparkSession) -> SparkSession:
    """The session with the engine's settings; all of them can change at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def session(master: str | None = None, **conf: str) -> SparkSession:
    # recording where in Python each column was made takes longer than making it
    builder = SparkSession.builder.appName("graphloom").config("spark.python.sql.dataFrameDebugging.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configured(builder.getOrCreate())

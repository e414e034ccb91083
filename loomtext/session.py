"""Session factory with the settings the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "loomtext", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI mode; `conf` overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

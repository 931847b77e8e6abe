"""SparkSession factory with the settings every plan here assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "veldspar", **extra: str) -> SparkSession:
    """Session with UTC, ANSI and adaptive execution on; `extra` wins over the defaults."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | extra)
    return (builder.master(master) if master else builder).getOrCreate()

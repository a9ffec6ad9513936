"""A session with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",  # GBK and GB18030 text files
}


def get_session(master: str | None = None, **more: str) -> SparkSession:
    """The current session or a new one; an existing session keeps its static settings."""
    builder = SparkSession.builder.config(map={**SETTINGS, **more})
    return (builder.master(master) if master else builder).getOrCreate()

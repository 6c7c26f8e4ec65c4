"""A session with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "loam", **conf: str) -> SparkSession:
    """An existing session, or one with adaptive execution, Arrow and UTC on."""
    wanted = {"spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.session.timeZone": "UTC"} | conf
    return SparkSession.builder.appName(app).config(map=wanted).getOrCreate()

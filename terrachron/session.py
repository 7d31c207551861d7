"""A Spark session with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "terrachron", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; master defaults to local[*] unless one is configured."""
    builder = SparkSession.builder.appName(app_name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.orc.impl": "native",
        "spark.sql.orc.filterPushdown": "true",
        "spark.sql.parquet.filterPushdown": "true",
        **conf,
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    if SparkSession.getActiveSession() is None and "spark.master" not in settings:
        import os

        if not os.environ.get("MASTER") and "--master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
            builder = builder.master("local[*]")
    return builder.getOrCreate()

"""A Spark session with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "corpusmill", **conf: str) -> SparkSession:
    """UTC, ANSI, AQE and Arrow on; further settings by keyword (``spark_sql_shuffle_partitions="64"``)."""
    b = SparkSession.builder.appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**base, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()

"""Session settings the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app_name: str = "fieldstats", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC time.

    ``master`` and sizes come from ``spark-submit`` or from ``conf``; nothing here
    assumes a local machine.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()

"""The session that the library's queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "tideline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings given to spark-submit stay."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**base, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()

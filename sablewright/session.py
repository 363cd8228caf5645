"""The Spark session the engine expects: UTC, adaptive execution, and nothing sized to one machine."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "sablewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` wins over them, keys with ``__`` for dots."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.maxPlanStringLength": "200000",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master or os.environ.get("SPARK_MASTER"):
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    return builder.config(map=settings).getOrCreate()

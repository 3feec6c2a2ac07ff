"""A session with the settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "netloom", **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; ``conf`` goes on top, its names without "spark." and with underscores for dots."""
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {f"spark.{k.replace('_', '.')}": v for k, v in conf.items()}
    builder = SparkSession.builder.appName(name)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()

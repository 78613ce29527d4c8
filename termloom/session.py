"""A session with the settings the engine expects; on a cluster pass your own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "termloom", master: str | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()

"""A session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",  # documents may be long
    "spark.sql.parquet.filterPushdown": "true",
}


def build(master: str | None = None, **more: str) -> SparkSession:
    b = SparkSession.builder.config(map=SETTINGS | more)
    return (b.master(master) if master else b).getOrCreate()

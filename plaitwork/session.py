"""Session settings that the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", partitions: int = 8, **more: str) -> SparkSession:
    """A session with the engine's defaults; more holds settings with __ for dots."""
    builder = SparkSession.builder.master(master).config(map={**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions)})
    for name, value in more.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

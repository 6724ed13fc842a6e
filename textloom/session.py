"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Options that hold at any scale; sizes of partitions are left to adaptive execution.
OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "textloom", master: str | None = None, **options: str) -> SparkSession:
    """A session with OPTIONS, and those given; ``master`` where it isn't set by spark-submit."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=OPTIONS | options).getOrCreate()

"""A session with the settings that plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """ANSI arithmetic (overflow is an error), UTC, adaptive execution with skew joins.

    On a cluster, leave ``shuffle_partitions`` out and let adaptive execution merge small partitions.
    """
    conf = {
        "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | settings
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder.config(map=conf)
    return (builder.master(master) if master else builder).getOrCreate()

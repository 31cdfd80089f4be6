"""Session settings used by the bench and the tests.

Operators do not depend on them: zone-free timestamps are used throughout, so
any session with adaptive execution gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed partitions of a join even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str, shuffle_partitions: int, **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("ticketlens")
    settings = {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **extra}
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

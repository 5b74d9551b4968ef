"""Session settings that the operators rely on for good plans."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Joins on (series, level) may reuse a placement by product and stay alone,
# so a model too large to broadcast never re-shuffles the fact per factor.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ebbline")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**PLAN_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

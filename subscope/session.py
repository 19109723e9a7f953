"""Spark session settings used by tests, the bench and the entry point."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings the library relies on. AQE re-plans joins from runtime sizes
# (broadcast only when the materialised side is below the threshold) and
# splits skewed shuffle partitions; the session time zone pins DATE(ts).
LIBRARY_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "subscope") -> SparkSession:
    """Local/test session. On a cluster use the cluster's session and call
    :func:`configure` on it instead."""
    master = master or os.environ.get("SUBSCOPE_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SUBSCOPE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no Python call site a column: building a plan takes less time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for k, v in LIBRARY_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the library settings to an existing (e.g. cluster) session."""
    for k, v in LIBRARY_CONF.items():
        spark.conf.set(k, v)
    return spark

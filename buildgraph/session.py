"""A Spark session with the settings the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "buildgraph", master: str | None = None, **extra: str) -> SparkSession:
    """Build or get a session.

    Adaptive execution, its skew-join handling and UTC timestamps are what the
    operators expect.  In local mode the shuffle width follows the cores;
    on a cluster it is left to the submitter.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Split skewed joins even when that costs another shuffle.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = (
                b.config("spark.sql.shuffle.partitions", "8")
                .config("spark.driver.memory", "12g")
                .config("spark.ui.enabled", "false")
            )
    for key, value in extra.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()

"""Intermediate tables of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from buildgraph.functions.storage import fresh_path


def stored(rows: DataFrame, label: str) -> DataFrame:
    """Write rows to the shared folder, compressed for size, and return a scan of them.

    For large tables only: Spark takes the size of the files for the size of the rows when it
    decides what to broadcast, so small sides of joins are better kept by ``materialize``.
    """
    spark = rows.sparkSession
    path = fresh_path(spark, label)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)

"""Intermediate tables in the cluster's shared folder.

Iterative operators cut their lineage by writing each round as a Parquet
table.  A written table outlives lost executors, has exact size statistics (so
Spark's own broadcast threshold sees the true size) and is computed once.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    Comes from ``spark.checkpoint.dir``.  Only a local-mode session may run
    without it; then a fresh temporary folder is used, once per application.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/") + "/buildgraph"
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.conf.get("spark.app.id", "app")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="buildgraph-")
    return _local_dirs[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has written to."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, label: str = "table") -> tuple[DataFrame, int]:
    """Like :func:`materialize`, also returning the row count.

    The count is observed while writing, so it costs no second job.
    """
    seen = Observation()
    stored = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return stored, seen.get["n"]


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int, label: str = "bucketed", distinct: bool = False) -> DataFrame:
    """Write ``df`` hashed by ``keys`` and return a scan that joins on them without an exchange.

    With ``distinct`` each row is written once; the copies of a row are in one bucket.

    The rows are in the shared folder; the session catalog holds their layout under a fresh name.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    rows = (dealt.distinct() if distinct else dealt).write.bucketBy(buckets, *keys).sortBy(*keys)
    rows.option("path", fresh_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def numbered(most: int | None) -> Iterable[int]:
    """The numbers of a loop's rounds: without end, unless the caller sets one."""
    return itertools.count() if most is None else range(most)


class Rounds:
    """Rows found so far by a loop, kept as a small number of stored tables.

    Eight tables of one level are merged into one of the next, so a loop of
    many rounds neither scans one table per round nor rewrites everything
    each time.
    """

    FAN = 8

    def __init__(self, first: DataFrame):
        self._levels: list[list[DataFrame]] = [[first]]

    def add(self, rows: DataFrame) -> None:
        """Add the rows of one round."""
        self._levels[0].append(rows)
        level = 0
        while len(self._levels[level]) >= self.FAN:
            merged = materialize(self.union_of(self._levels[level]), "merged")
            self._levels[level] = []
            level += 1
            if level == len(self._levels):
                self._levels.append([])
            self._levels[level].append(merged)

    @staticmethod
    def union_of(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def all(self) -> DataFrame:
        """Everything found so far."""
        return self.union_of([p for level in self._levels for p in level])

"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.storage import materialize, materialize_counted

#: Rows a task writes, about; so small tables of a round are not dealt over all shuffle partitions.
TASK_ROWS = 20_000


def _only_stars(edges: DataFrame) -> bool:
    """Whether each larger end of ``edges`` (a, b), a below b, has one smaller end, which has none itself."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("x").agg(F.max("up").alias("up"), F.sum("down").alias("down"))
    return nodes.where("down + up > 1").isEmpty()


def stars(roots: DataFrame) -> DataFrame:
    """(a, b): links that stand for the components of ``roots`` (node, root), one per node that is not the root."""
    return roots.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of ``edges`` (a, b) can reach.

    Alternates two star steps until only stars are left: every node hands its larger
    neighbours to its smallest one, then its smaller neighbours.  The
    rounds grow with the logarithm of the longest path.  A step keeps at most
    one row per edge, neighbours are never gathered into one value, and each round
    is written to the shared folder, by as many tasks as its rows ask for.
    """
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges, n = materialize_counted(pairs.distinct(), "cc")
    while True:
        few = -(-2 * n // TASK_ROWS) or 1

        def written(rows: DataFrame, label: str = "cc") -> DataFrame:
            return materialize(rows.coalesce(few) if few < width else rows, label)

        if _only_stars(edges):
            break
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Stored, so that a node of very many neighbours can be split in the join.
        least = written(least, "cc-least")
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a != b")
        large = written(large)
        low = written(large.groupBy("b").agg(F.min("a").alias("m")), "cc-least")
        small = large.join(low, "b").select(F.col("m").alias("lo"), "a", "b")
        small = small.select(F.explode(F.array(F.struct("lo", F.col("a").alias("hi")), F.struct("lo", F.col("b").alias("hi")))).alias("e"))
        small = small.select(F.col("e.lo").alias("a"), F.col("e.hi").alias("b")).where("a != b").distinct()
        edges, n = materialize_counted(small.coalesce(few) if few < width else small, "cc")
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())

"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.storage import bucketed, materialize_counted

#: Rows of one key from which it is split, and rows of a piece.
MIN_ROWS = 100_000
#: At most this many keys are split, heaviest first.  A key that is not listed holds less than
#: 1/``MOST`` of the rows (10 million of 10^12), which a task takes; the table has a fixed bound.
MOST = 100_000


def pieces(n: Column, rows: int = MIN_ROWS) -> Column:
    """How many pieces of at most about ``rows`` rows a key of ``n`` rows is split into."""
    return F.ceil(n / F.lit(rows)).cast("bigint")


def hot_keys(
    df: DataFrame, keys: Sequence[str], min_rows: int = MIN_ROWS, most: int = MOST
) -> DataFrame:
    """The heaviest keys of ``df`` and their ``_pieces``: at most ``most`` rows, by a combined count."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    heavy = counted.filter(F.col("_n") >= min_rows)
    for k in keys:
        heavy = heavy.filter(F.col(k).isNotNull())
    # Ties are broken by key: both sides of a join must see the same hot keys.
    heavy = heavy.orderBy(F.col("_n").desc(), *keys).limit(most)
    return heavy.select(*keys, pieces(F.col("_n"), min_rows).alias("_pieces"))


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread: Sequence[str | Column] | None = None,
    hot: DataFrame | None = None,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Equi join of ``facts`` with ``dim``, splitting only the hot keys of ``facts``.

    Hot keys (at most :data:`MOST` rows, hence broadcast) get a salt below their number
    of pieces, derived from the ``spread`` columns of ``facts``; the matching
    ``dim`` rows are repeated once per piece.  Rows with a null key match nothing and
    are spread freely.  Other keys join as usual.  The salt is a hash of row
    content, so a recomputed task produces the same rows.  ``dim`` is not broadcast:
    its size is guessed from the files it comes from, which exploded rows exceed many times.
    """
    on = list(on)
    if hot is None:
        hot = hot_keys(facts, on, min_rows)
    flagged = F.broadcast(hot.select(*on, "_pieces"))
    if spread is None:
        spread = [F.col(f"`{c}`") for c in facts.columns if c not in on]
    content = F.xxhash64(*spread) if spread else F.lit(0).cast("bigint")
    missing = F.lit(False)
    for k in on:
        missing = missing | F.col(k).isNull()
    salt = F.when(missing, content).when(
        F.col("_pieces").isNotNull(), F.pmod(content, F.col("_pieces"))
    )
    left = facts.join(flagged, on, "left").withColumn("_salt", F.coalesce(salt, F.lit(0)))
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_pieces", F.lit(1)) - 1)
    right = dim.join(flagged, on, "left").withColumn("_salt", F.explode(copies)).drop("_pieces")
    return left.drop("_pieces").join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")


#: Rows from which a loop's table is hashed into buckets by its key, so that a round exchanges only
#: the rows it brings; below, writing buckets costs more than the exchange.  The results are equal.
BUCKETED_ROWS = 1_000_000
#: Rows of a bucket, about.
BUCKET_ROWS = 500_000


class StoredTable:
    """A table written once for a loop, with its hot keys known beforehand.

    ``join`` splits the hot keys like :func:`lookup_join`.  Without any, a large table is
    kept in buckets of the join key, which no round has to exchange; a small one is joined
    plainly, and Spark broadcasts the other side only while it is small.  ``distinct`` keeps each row
    once; ``n_rows`` may count copies then.
    """

    def __init__(
        self,
        rows: DataFrame,
        keys: Sequence[str],
        spread: Sequence[str] | None = None,
        min_rows: int = MIN_ROWS,
        distinct: bool = False,
    ):
        self.keys = list(keys)
        self.spread = spread
        self.hot, self.n_hot = None, 0
        width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if distinct:
            # Without hot keys, copies meet in the buckets and need no exchange of their own.
            rows, n = materialize_counted(rows, "copies")
            if n >= BUCKETED_ROWS and hot_keys(rows, self.keys, min_rows).isEmpty():
                self.n_rows = n
                buckets = max(width, -(-n // BUCKET_ROWS))
                self.rows = bucketed(rows, self.keys, buckets, distinct=True)
                return
            rows = rows.distinct()
        self.rows, self.n_rows = materialize_counted(rows, "stored")
        if self.n_rows >= min_rows:
            self.hot, self.n_hot = materialize_counted(
                hot_keys(self.rows, self.keys, min_rows), "hot"
            )
        if self.n_hot == 0 and self.n_rows >= BUCKETED_ROWS:
            self.rows = bucketed(self.rows, self.keys, max(width, -(-self.n_rows // BUCKET_ROWS)))

    def join(self, dim: DataFrame, how: str = "inner") -> DataFrame:
        """Join the table with ``dim`` on the keys."""
        if self.n_hot == 0:
            return self.rows.join(dim, self.keys, how)
        return lookup_join(self.rows, dim, self.keys, how, spread=self.spread, hot=self.hot)

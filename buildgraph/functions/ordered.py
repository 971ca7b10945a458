"""Order-dependent computations that never put a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(seq)`` sorts all rows of a key in a
single task.  These functions cut each key into blocks of bounded size, solve
the blocks independently, and pass a one-row summary per block forward.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildgraph.functions.storage import materialize

#: Positions per block: a (key, block) group never holds more rows than this.
BLOCK_ROWS = 1 << 20

_INDEX_BITS = 33  # monotonically_increasing_id: partition id above, row index below


def block_of(order: str | Column, block_rows: int = BLOCK_ROWS) -> Column:
    """Block number of a row whose position is the integer ``order`` (unique per key)."""
    col = F.col(order) if isinstance(order, str) else order
    return F.floor(col / F.lit(block_rows)).cast("bigint")


def fill_forward(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str],
    values: dict[str, Column],
) -> DataFrame:
    """Last non-null value at or before each row, per key.

    ``values`` maps output column to the expression carried forward.  ``block``
    must be ordered consistently with ``order``.
    """
    keys = list(keys)
    pos = F.struct(*[F.col(c) for c in order])
    inside = {f"_v_{o}": e for o, e in values.items()}
    df = df.withColumns(inside)
    last = [
        F.max_by(F.col(f"_v_{o}"), F.when(F.col(f"_v_{o}").isNotNull(), pos)).alias(f"_l_{o}")
        for o in values
    ]
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        df.groupBy(*keys, block)
        .agg(*last)
        .select(
            *keys,
            block,
            *[F.last(F.col(f"_l_{o}"), True).over(before).alias(f"_c_{o}") for o in values],
        )
    )
    upto = (
        Window.partitionBy(*keys, block)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = df.join(carry, [*keys, block], "left")
    filled = {
        o: F.coalesce(F.last(F.col(f"_v_{o}"), True).over(upto), F.col(f"_c_{o}")) for o in values
    }
    drop = [f"_v_{o}" for o in values] + [f"_c_{o}" for o in values]
    return joined.withColumns(filled).drop(*drop)


def running_count(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], flag: Column, out: str
) -> DataFrame:
    """Number of rows strictly before each row, per key, for which ``flag`` holds."""
    keys = list(keys)
    df = df.withColumn("_f", F.coalesce(flag.cast("int"), F.lit(0)))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        df.groupBy(*keys, block)
        .agg(F.sum("_f").alias("_s"))
        .select(*keys, block, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_c"))
    )
    inner = (
        Window.partitionBy(*keys, block)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        df.join(carry, [*keys, block], "left")
        .withColumn(
            out, (F.coalesce(F.sum("_f").over(inner), F.lit(0)) + F.col("_c")).cast("bigint")
        )
        .drop("_f", "_c")
    )


def range_blocks(df: DataFrame, order: Sequence[str], label: str = "blocks") -> DataFrame:
    """Range-partition ``df`` by ``order`` and store it with ``_block`` and ``_index``.

    Blocks follow the order and are balanced whatever the key distribution,
    because the ranges are cut on all of ``order``, not on the key alone.
    ``_index`` is the row's place inside its block.  The result is written
    once, so every later use sees the same cut.
    """
    order = list(order)
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    cut = cut.withColumn("_place", place)
    stored = materialize(cut, label)
    return stored.withColumns(
        {
            "_block": F.shiftright("_place", _INDEX_BITS),
            "_index": F.col("_place").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)),
        }
    ).drop("_place")


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "position"
) -> DataFrame:
    """1-based position of each row within its key, in ``order``.

    Needs neither an unpartitioned window nor all rows of a key in one task.
    ``order`` should identify rows; rows equal on it share one range.
    """
    keys = list(keys)
    blocks = range_blocks(df, [*keys, *order], "numbered")
    sizes = blocks.groupBy(*keys, "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_index").alias("_first")
    )
    # One row per block (no keys) or per key and block: summaries, not data.
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_block")
    offsets = sizes.withColumn(
        "_offset",
        F.coalesce(
            F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    ).drop("_n")
    if not keys:
        # At most one row per range partition.
        offsets = F.broadcast(offsets)
    return (
        blocks.join(offsets, [*keys, "_block"])
        .withColumn(
            out, (F.col("_offset") + F.col("_index") - F.col("_first") + F.lit(1)).cast("bigint")
        )
        .drop("_block", "_index", "_first", "_offset")
    )

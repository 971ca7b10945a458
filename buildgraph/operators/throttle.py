"""Throttled emission: at most one update per key and interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buildgraph.functions.ordered import range_blocks
from buildgraph.functions.skew import MIN_ROWS, lookup_join
from buildgraph.functions.storage import Rounds, materialize, materialize_counted

#: Keys up to this many events are folded inside one row, where an emission copies those
#: before it; larger ones are chained.  The results are equal.
FOLD_ROWS = 256


def _fold(events: DataFrame, keys: Sequence[str], micros: str, order: str, gap: int) -> DataFrame:
    """Greedy emission by an array fold; keys hold at most :data:`FOLD_ROWS` events."""
    rows = F.array_sort(
        F.collect_list(F.struct(F.col(micros).alias("t"), F.col(order).alias("o")))
    )
    start = F.filter(rows, lambda _: F.lit(False))

    def step(acc, row):
        last = F.element_at(acc, F.lit(-1))
        due = (F.size(acc) == 0) | (row["t"] - last["t"] >= gap)
        return F.when(due, F.concat(acc, F.array(row))).otherwise(acc)

    chosen = F.aggregate(rows, start, step)
    return (
        events.groupBy(*keys)
        .agg(chosen.alias("_rows"))
        .select(*keys, F.explode("_rows").alias("r"))
        .select(*keys, F.col("r.t").alias(micros), F.col("r.o").alias(order))
    )


def _next_due(events: DataFrame, keys: Sequence[str], micros: str, order: str, gap: int):
    """For every event the first one at least ``gap`` later (``n_t``, ``n_o``), if any.

    Probes at ``time + gap`` are merged with the events, cut into range blocks,
    and each probe takes the first event at or behind it: inside its block, or
    the first event of a later block.
    """
    base = events.select(*keys, F.col(micros).alias("t"), F.col(order).alias("o"))
    # An event equal in time to a probe is due, so probes (kind 0) sort first.
    merged = base.withColumn("kind", F.lit(1)).unionByName(
        base.select(*keys, (F.col("t") + gap).alias("t"), "o", F.lit(0).alias("kind"))
    )
    blocks = range_blocks(merged, [*keys, "t", "kind", "o"], "throttle")
    event = F.when(F.col("kind") == 1, F.struct("t", "o"))
    heads = blocks.groupBy(*keys, "_block").agg(F.min(event).alias("_head"))
    # Read backwards: growing frames are incremental, shrinking ones start over per row.
    done = (Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col("_block").desc()).rowsBetween(*done)
    behind = heads.select(*keys, "_block", F.last("_head", True).over(later).alias("_behind"))
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(F.col("_index").desc()).rowsBetween(*done)
    )
    due = F.coalesce(F.last(event, True).over(inside), F.col("_behind"))
    return (
        blocks.join(behind, [*keys, "_block"])
        .withColumn("_n", due)
        .filter(F.col("kind") == 0)
        .select(
            *keys,
            (F.col("t") - gap).alias("t"),
            "o",
            F.col("_n.t").alias("n_t"),
            F.col("_n.o").alias("n_o"),
        )
    )


def _chain(events: DataFrame, keys: Sequence[str], micros: str, order: str, gap: int) -> DataFrame:
    """Greedy emission for keys of any size, by pointer doubling.

    Every event points to the next one due after it.  The emitted events are
    those reached from the first; in round k the reached set jumps 2^k steps,
    so the number of rounds is the logarithm of the emissions per key.
    """
    keys = list(keys)
    first = events.groupBy(*keys).agg(
        F.min(F.struct(F.col(micros).alias("t"), F.col(order).alias("o"))).alias("f")
    )
    jumps = materialize(_next_due(events, keys, micros, order, gap), "next")
    reached = materialize(first.select(*keys, "f.t", "f.o"), "reached")
    # Only the first event and events some pointer leads to can be emitted.
    nodes = reached.unionByName(
        jumps.filter("n_o IS NOT NULL").select(
            *keys, F.col("n_t").alias("t"), F.col("n_o").alias("o")
        )
    ).distinct()
    jumps, n_jumps = materialize_counted(
        jumps.filter("n_o IS NOT NULL").join(nodes, [*keys, "t", "o"], "left_semi"), "jump"
    )
    rounds = Rounds(reached)
    while True:
        everything = rounds.all()
        new, n = materialize_counted(
            everything.join(jumps, [*keys, "t", "o"]).select(
                *keys, F.col("n_t").alias("t"), F.col("n_o").alias("o")
            ),
            "reached",
        )
        if n == 0:
            return everything.select(
                *keys, F.col("t").alias(micros), F.col("o").alias(order)
            )
        rounds.add(new)
        ahead = jumps.select(
            *keys,
            F.col("t").alias("n_t"),
            F.col("o").alias("n_o"),
            F.col("n_t").alias("m_t"),
            F.col("n_o").alias("m_o"),
        )
        # Many events may point to one; below MIN_ROWS no target can be hot.
        on = [*keys, "n_t", "n_o"]
        if n_jumps < MIN_ROWS:
            twice = jumps.join(ahead, on)
        else:
            twice = lookup_join(jumps, ahead, on, "inner", spread=["t", "o"])
        jumps, n_jumps = materialize_counted(
            twice.select(*keys, "t", "o", F.col("m_t").alias("n_t"), F.col("m_o").alias("n_o")),
            "jump",
        )


def throttle(
    events: DataFrame,
    keys: Sequence[str],
    seconds: float,
    micros: str = "ts_us",
    order: str = "seq",
    fold_rows: int = FOLD_ROWS,
    last_always: bool = True,
) -> DataFrame:
    """Events that are emitted when updates of a key are at least ``seconds`` apart.

    The first event of a key is emitted, then each that is due since the last
    emission, and always the last event (unless ``last_always`` is off).  Keys
    with few events are folded in one row; larger ones go through pointer
    doubling, which has no size limit.  Returns keys, time and order.
    """
    keys = list(keys)
    gap = int(seconds * 1_000_000)
    if gap <= 0:
        raise ValueError("seconds must be positive")
    slim = events.select(*keys, micros, order)
    large, n_large = materialize_counted(
        slim.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > fold_rows)
        .select(*keys),
        "large",
    )
    if n_large == 0:
        chosen = _fold(slim, keys, micros, order, gap)
    else:
        small = slim.join(large, keys, "left_anti")
        big = slim.join(large, keys, "left_semi")
        chosen = _fold(small, keys, micros, order, gap).unionByName(
            _chain(big, keys, micros, order, gap)
        )
    if not last_always:
        return chosen
    last = (
        slim.groupBy(*keys)
        .agg(F.max(F.struct(F.col(micros).alias("t"), F.col(order).alias("o"))).alias("l"))
        .select(*keys, F.col("l.t").alias(micros), F.col("l.o").alias(order))
    )
    return chosen.unionByName(last).distinct()

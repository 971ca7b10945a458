"""Target states, durations, log tails, retries and end-of-run resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildgraph.functions.ordered import BLOCK_ROWS, block_of, running_count
from buildgraph.functions.storage import materialize
from buildgraph.functions.text import last_lines
from buildgraph.operators.filters import TRANSIENT_PATTERNS, transient

TAIL_LINES = 20
BUFFER_LINES = 200
#: Spark prunes ``row_number() <= n`` before the shuffle only up to this n.
GROUP_LIMIT = 1000


def _state(status: Column) -> Column:
    return (
        F.when(status == "started", "building")
        .when(status.isin("succeeded", "substitution"), "succeeded")
        .when(status.isin("failed", "skipped"), status)
    )


def last_events(events: DataFrame, order: str = "seq") -> DataFrame:
    """Last state per target, and the exit code of its last failure."""
    live = events.filter(F.col("status") != "line")
    failed_at = F.when(F.col("status") == "failed", F.col(order))
    return live.groupBy("tree_path").agg(
        F.max_by(_state(F.col("status")), F.col(order)).alias("state"),
        F.max_by("exit_code", failed_at).alias("exit_code"),
    )


def final_state(events: DataFrame, targets: DataFrame, order: str = "seq") -> DataFrame:
    """State of every target after all events; ``pending`` without any.

    The last event decides: started is building, success and substitution are
    succeeded, failed and skipped are themselves.
    """
    return targets.join(last_events(events, order), "tree_path", "left").withColumn(
        "state", F.coalesce("state", F.lit("pending"))
    )


def build_spans(
    events: DataFrame, order: str = "seq", micros: str = "ts_us", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Stretches of starts up to the result that ends them, per target.

    Rows (tree_path, _span, first_seq, last_seq, first_start, last_start, end); the last
    stretch of a target has no ``end`` while it is building.
    """
    live = events.filter(F.col("status").isin("started", "succeeded", "failed", "substitution"))
    live = live.select(
        "tree_path",
        F.col(order).alias("_o"),
        F.col(micros).alias("_t"),
        (F.col("status") != "started").alias("_r"),
    ).withColumn("_block", block_of("_o", block_rows))
    start = F.when(~F.col("_r"), F.col("_o"))
    # Rows between two results share a span number, so a span is a plain group.
    return (
        running_count(live, ["tree_path"], "_block", ["_o"], F.col("_r"), "_span")
        .groupBy("tree_path", "_span")
        .agg(
            F.min(start).alias("first_seq"),
            F.max(start).alias("last_seq"),
            F.min_by("_t", start).alias("first_start"),
            F.max_by("_t", start).alias("last_start"),
            F.max_by("_t", F.when(F.col("_r"), F.col("_o"))).alias("end"),
        )
    )


def durations(
    events: DataFrame,
    order: str = "seq",
    micros: str = "ts_us",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Build time per target in milliseconds, by both definitions.

    ``duration_latest_ms``: from the latest start before the last result to
    that result.  ``duration_total_ms``: sum over closed spans, each from the
    first start not yet closed to the result closing it.
    """
    spans = build_spans(events, order, micros, block_rows).filter(F.col("end").isNotNull())
    length = F.floor((F.col("end") - F.col("first_start")) / 1000)
    open_span = F.when(F.col("last_start").isNotNull(), F.col("_span"))
    per_target = spans.groupBy("tree_path").agg(
        F.max_by("end", "_span").alias("_end"),
        F.max_by("last_start", open_span).alias("_start"),
        F.coalesce(F.sum(length), F.lit(0)).cast("bigint").alias("duration_total_ms"),
    )
    return per_target.select(
        "tree_path",
        F.floor((F.col("_end") - F.col("_start")) / 1000)
        .cast("bigint")
        .alias("duration_latest_ms"),
        "duration_total_ms",
    )


def last_rows(
    df: DataFrame, key: str, order: str, n: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The last ``n`` rows per key.

    Up to 1000 rows Spark prunes every key before the shuffle.  Beyond that the
    keys are first pruned per block, so no task sees a whole key either.
    """
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    if n > GROUP_LIMIT:
        inner = Window.partitionBy(key, "_block").orderBy(F.col(order).desc())
        df = (
            df.withColumn("_block", block_of(order, block_rows))
            .withColumn("_rn", F.row_number().over(inner))
            .filter(F.col("_rn") <= n)
            .drop("_rn", "_block")
        )
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)


def line_buffer(
    lines: DataFrame, buffer: int = BUFFER_LINES, key: str = "tree_path", order: str = "seq"
) -> DataFrame:
    """The last ``buffer`` output lines per target."""
    return last_rows(lines, key, order, buffer).drop("_rn")


def log_tail(
    lines: DataFrame,
    n: int = TAIL_LINES,
    buffer: int = BUFFER_LINES,
    key: str = "tree_path",
    order: str = "seq",
    text: str = "line",
) -> DataFrame:
    """Last lines per target: ``log`` joins the buffered lines, ``log_tail`` the last ``n``.

    Targets without a line have no row.
    """
    kept = last_rows(lines, key, order, buffer)
    entry = F.struct(F.col(order).alias("o"), F.col(text).alias("t"))

    def joined(rows: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(rows), lambda r: r["t"]), "\n")

    # At most `buffer` lines per key are gathered here.
    return kept.groupBy(key).agg(
        joined(F.collect_list(entry)).alias("log"),
        joined(F.collect_list(F.when(F.col("_rn") <= n, entry))).alias("log_tail"),
    )


def apply_retries(
    results: DataFrame,
    attempts: DataFrame,
    max_retries: int = 3,
    patterns: Sequence[str] = TRANSIENT_PATTERNS,
    tail: int = TAIL_LINES,
) -> DataFrame:
    """Fold retry attempts into the results of a run.

    Only failed targets with a non-empty ``log`` holding a transient pattern
    are retried.  Success at attempt k: succeeded, exit code 0, retry count k,
    that attempt's time added.  All attempts failed: still failed, retry count
    ``max_retries``, log tail kept.  Not transient: log tail kept, no count.
    ``backoff_s`` is the total wait, 5·k seconds before attempt k.
    ``attempts`` has tree_path, attempt, ok, duration_ms.
    """
    won = (
        attempts.filter(F.col("ok") & (F.col("attempt") <= max_retries))
        .groupBy("tree_path")
        .agg(
            F.min("attempt").alias("_k"),
            F.min_by("duration_ms", "attempt").alias("_ms"),
        )
    )
    tried = (
        (F.col("status") == "failed")
        & (F.coalesce("log", F.lit("")) != "")
        & F.lit(max_retries > 0)
    )
    joined = results.join(won, "tree_path", "left").withColumns(
        {"_tried": tried, "_transient": tried & transient("log", patterns)}
    )
    success = F.col("_transient") & F.col("_k").isNotNull()
    used = F.when(success, F.col("_k")).otherwise(F.lit(max_retries)).cast("int")
    return joined.withColumns(
        {
            "_status": F.when(success, "succeeded").otherwise(F.col("status")),
            "exit_code": F.when(success, F.lit(0).cast("bigint")).otherwise(F.col("exit_code")),
            "duration_ms": F.when(
                success, F.coalesce("duration_ms", F.lit(0)) + F.col("_ms")
            ).otherwise(F.col("duration_ms")),
            "retry_count": F.when(F.col("_transient"), used),
            "log_tail": F.when(F.col("_tried") & ~success, last_lines("log", tail)),
            "backoff_s": F.when(F.col("_transient"), F.lit(5) * used * (used + 1) / 2)
            .otherwise(F.lit(0))
            .cast("bigint"),
        }
    ).withColumn("status", F.col("_status")).drop("_status", "_tried", "_transient", "_k", "_ms")


def resolve_pending(
    results: DataFrame, outputs: DataFrame, store: DataFrame, run_ok: bool
) -> DataFrame:
    """Decide targets that never reported.

    After a successful run they succeeded.  Otherwise they succeeded if every
    output exists in ``store`` (no outputs counts as all), else they were
    skipped.  ``outputs`` has drv_path and path, ``store`` has path.
    """
    pending = F.col("status") == "pending"
    if run_ok:
        return results.withColumn(
            "status", F.when(pending, "succeeded").otherwise(F.col("status"))
        )
    missing = (
        outputs.select("drv_path", "path")
        .join(store.select("path"), "path", "left_anti")
        .select("drv_path")
        .distinct()
        .withColumn("_missing", F.lit(True))
    )
    resolved = F.when(F.col("_missing"), "skipped").otherwise("succeeded")
    return (
        results.join(missing, "drv_path", "left")
        .withColumn("status", F.when(pending, resolved).otherwise(F.col("status")))
        .drop("_missing")
    )


def state_counts(state: DataFrame, by: Sequence[str] = (), col: str = "state") -> DataFrame:
    """Targets in each of the five states; reported failures are failed plus skipped."""
    names = ("pending", "building", "succeeded", "failed", "skipped")
    counts = [F.count_if(F.col(col) == n).alias(n) for n in names]
    reported = F.count_if(F.col(col).isin("failed", "skipped")).alias("failures")
    return state.groupBy(*by).agg(*counts, reported)


def all_succeeded(results: DataFrame, by: Sequence[str] = (), col: str = "status") -> DataFrame:
    """Whether every target succeeded; true for none.  A null status is no success."""
    flag = F.coalesce(F.bool_and(F.coalesce(F.col(col) == "succeeded", F.lit(False))), F.lit(True))
    return results.groupBy(*by).agg(flag.alias("success"))


def join_results(state: DataFrame, results: DataFrame) -> DataFrame:
    """Every tracked target, with exit code and log tail from its result when there is one."""
    found = results.select("tree_path", "exit_code", "log_tail")
    return state.drop("exit_code", "log_tail").join(found, "tree_path", "left")


def run_results(
    events: DataFrame,
    targets: DataFrame,
    attempts: DataFrame,
    outputs: DataFrame,
    store: DataFrame,
    run_ok: bool,
    max_retries: int = 3,
) -> DataFrame:
    """Results of a finished run: last result, durations, logs, retries, then resolution.

    The events are stored first; each part of the fold reads them.
    """
    events = materialize(events, "run-events")
    done = events.filter(F.col("status").isin("succeeded", "failed", "substitution"))
    last = done.groupBy("tree_path").agg(
        F.max_by(F.struct(_state(F.col("status")).alias("s"), "exit_code"), "seq").alias("r")
    )
    logs = log_tail(events.filter(F.col("status") == "line")).select("tree_path", "log")
    times = durations(events).select("tree_path", F.col("duration_latest_ms").alias("duration_ms"))
    base = (
        targets.join(last, "tree_path", "left")
        .join(times, "tree_path", "left")
        .join(logs, "tree_path", "left")
        .withColumns(
            {
                "status": F.coalesce("r.s", F.lit("pending")),
                "exit_code": F.col("r.exit_code"),
            }
        )
        .drop("r")
    )
    folded = apply_retries(base, attempts, max_retries)
    return resolve_pending(folded, outputs, store, run_ok).drop("log")

"""Attribution of build-log records to targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.ordered import BLOCK_ROWS, block_of, fill_forward
from buildgraph.functions.skew import MIN_ROWS, lookup_join

OUTPUT_LINE = 101  # result type of a builder output line
FAILURE = 0  # result type of a finished build; other types mark success


def target_lookup(targets: DataFrame) -> DataFrame:
    """One (drv, target_path, target_system) row per derivation.

    Of targets sharing a derivation the smallest tree path counts.  A target
    without a system has the empty one.
    """
    chosen = F.min(F.struct("tree_path", F.coalesce("system", F.lit("")).alias("s")))
    return (
        targets.groupBy(F.col("drv_path").alias("drv"))
        .agg(chosen.alias("t"))
        .select(
            "drv", F.col("t.tree_path").alias("target_path"), F.col("t.s").alias("target_system")
        )
    )


def start_drv() -> Column:
    """Derivation named by a start record."""
    return F.coalesce("arg_text", F.lit("unknown"))


def bind_records(
    log: DataFrame,
    targets: DataFrame,
    carried: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
    hot_rows: int = MIN_ROWS,
) -> DataFrame:
    """Start and result records with what their id is bound to, in column ``bound``.

    A start binds its id to a derivation and, through ``targets``, to a target;
    a later start of the same id rebinds it.  Only start records meet the
    target table; results inherit the finished binding.  ``carried`` holds
    (run, id, carried): bindings made before the first record.
    """
    is_start = F.col("action") == "start"
    is_result = (F.col("action") == "result") & F.col("id").isNotNull() & F.col("type").isNotNull()
    starts = lookup_join(
        log.filter(is_start).withColumn("drv", start_drv()),
        target_lookup(targets),
        ["drv"],
        "left",
        spread=["run", "seq"],
        min_rows=hot_rows,
    )
    binding = F.struct("drv", "target_path", "target_system")
    starts = starts.withColumn("_bind", binding).drop("drv", "target_path", "target_system")
    nothing = F.lit(None).cast(starts.schema["_bind"].dataType)
    rows = starts.unionByName(log.filter(is_result).withColumn("_bind", nothing))
    rows = rows.withColumn("_block", block_of("seq", block_rows))
    bound = fill_forward(rows, ["run", "id"], "_block", ["seq"], {"bound": F.col("_bind")})
    # A start is its own last binding, also one without an id, which binds nothing else.
    if carried is not None:
        bound = (
            bound.join(carried, ["run", "id"], "left")
            .withColumn("bound", F.coalesce("bound", "carried"))
            .drop("carried")
        )
    return bound.drop("_bind", "_block")


def attribute_log(
    log: DataFrame,
    targets: DataFrame,
    strict: bool = False,
    carried: DataFrame | None = None,
    lines: bool = True,
    block_rows: int = BLOCK_ROWS,
    hot_rows: int = MIN_ROWS,
) -> DataFrame:
    """Build events from log records, attributed to targets.

    ``log`` has run, seq (integer, unique per run), action, id, type, arg_text,
    arg_int; further columns are kept.  A result takes the derivation its id
    was last bound to.  ``status`` is started, succeeded, failed or line:

    * start: path falls back to the derivation, system to ``unknown``;
    * output line (type 101): path falls back to ``build``, also when the
      derivation is no target; ``line`` holds the text;
    * other results: dropped if the id was never bound; failed when the type is
      0 and the exit code is not, else succeeded.  With ``strict`` only type 0
      counts.

    Other records carry no target and are dropped.  ``lines=False`` leaves the
    output lines, the bulk of a log, out before anything is shuffled.
    """
    if not lines:
        log = log.filter(~F.col("type").eqNullSafe(OUTPUT_LINE) | (F.col("action") == "start"))
    return described(bind_records(log, targets, carried, block_rows, hot_rows), log.columns, strict)


def described(bound: DataFrame, columns: list[str], strict: bool = False) -> DataFrame:
    """Build events from bound records (the ``columns`` of a log and ``bound``); see :func:`attribute_log`."""
    is_start = F.col("action") == "start"
    is_line = ~is_start & (F.col("type") == OUTPUT_LINE)
    wanted = is_start | is_line | F.col("bound").isNotNull()
    if strict:
        wanted = wanted & (is_start | is_line | (F.col("type") == FAILURE))
    named = bound.filter(wanted).select("*", "bound.*").drop("bound")
    ok = (F.col("type") != FAILURE) | F.coalesce(F.col("arg_int") == 0, F.lit(False))
    status = (
        F.when(is_start, "started")
        .when(is_line, "line")
        .when(ok, "succeeded")
        .otherwise("failed")
    )
    kept = [
        c
        for c in columns
        if c not in ("run", "seq", "action", "id", "type", "arg_text", "arg_int")
    ]
    return named.select(
        "run",
        "seq",
        F.when(is_line, F.coalesce("target_path", F.lit("build")))
        .otherwise(F.coalesce("target_path", "drv"))
        .alias("tree_path"),
        F.col("drv").alias("drv_path"),
        F.when(~is_line, F.coalesce("target_system", F.lit("unknown"))).alias("system"),
        status.alias("status"),
        F.when(~is_start & ~is_line, F.col("arg_int")).alias("exit_code"),
        F.when(is_line, F.coalesce("arg_text", F.lit(""))).alias("line"),
        *kept,
    )


def messages(log: DataFrame) -> DataFrame:
    """Global diagnostic messages of a log; they belong to no target."""
    return log.filter(F.col("action") == "msg").select(
        "run", "seq", F.coalesce("msg", F.lit("")).alias("message")
    )

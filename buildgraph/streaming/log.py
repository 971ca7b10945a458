"""Streaming twins of log attribution, target state, throttling and line buffers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from buildgraph.operators import state as s
from buildgraph.operators.attribution import described, start_drv, target_lookup
from buildgraph.operators.graph import GrowingDependents
from buildgraph.sources.readers import read_result_rows
from buildgraph.sources.writers import write_results
from buildgraph.streaming import keyed
from buildgraph.streaming.keyed import Bindings, LastLines, LiveTarget, Throttle, with_state

BINDING = "drv string, target_path string, target_system string"


def attribute_stream(
    log: DataFrame,
    targets: DataFrame,
    root: str,
    strict: bool = False,
    closing: str = "action = 'stop'",
    linger_s: float = 60,
    timers: bool = False,
    **trigger,
) -> StreamingQuery:
    """Stream of attributed events below ``root/output``; equal to :func:`attribute_log` over all batches.

    The state is the binding of every open (run, id).  ``closing`` is a condition on records that end an id;
    ``linger_s`` later its binding is dropped by a timer.  Starts without an id bind nothing and
    leave no state.  Only start records meet the target table.
    """
    ends = F.coalesce(F.expr(closing), F.lit(False))
    is_start = F.coalesce(F.col("action") == "start", F.lit(False))
    is_result = (F.col("action") == "result") & F.col("id").isNotNull() & F.col("type").isNotNull()
    rows = log.where(is_start | is_result | (ends & F.col("id").isNotNull()))
    # Other records get a key of their own, which no derivation has.
    key = F.when(is_start, start_drv()).otherwise(F.concat(F.lit("\0"), F.col("seq").cast("string")))
    rows = rows.withColumn("drv", key).join(target_lookup(targets), "drv", "left")
    bind = [F.col(c).alias(f"bind_{c}") for c in ("drv", "target_path", "target_system")]
    rows = rows.select(
        *log.columns,
        is_start.alias("is_start"),
        (ends & ~is_start & ~F.coalesce(is_result, F.lit(False))).alias("closing"),
        *bind,
        F.when(F.col("id").isNull(), F.col("seq")).alias("lone"),
    )
    schema = StructType([*log.schema.fields, StructField("bound", StructType.fromDDL(BINDING))])
    processor = Bindings(log.columns, BINDING, int(linger_s * 1000))
    bound = with_state(rows, ["run", "id", "lone"], processor, schema)
    return keyed.start(described(bound, log.columns, strict), root, "attribution", timers, **trigger)


def live_state_stream(events: DataFrame, root: str, edges: DataFrame, **trigger) -> StreamingQuery:
    """Live state per target from attributed events, and the targets behind failures; read by :func:`live_report`.

    The state of a target is folded by its key.  Targets that failed for the first time extend the set
    of those that depend on a failure from where they are; a batch without one follows no edge.  If a failed
    target recovers, the set is built anew from those that are failed still.  What a batch adds is a folder
    named after it below ``root``, written over if the batch runs again.
    """
    spark = events.sparkSession
    fields = f"tree_path string, {LiveTarget.FIELDS}"
    live = with_state(events.filter("status <> 'line'").select("tree_path", "seq", "ts_us", "status", "exit_code"), ["tree_path"], LiveTarget(), fields)
    graph = GrowingDependents(edges)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/output/batch={batch_id}")
        # Read back with the partitions of the table, not those of the state store.
        now = spark.read.schema(fields).parquet(f"{root}/output/batch={batch_id}")
        failed, earlier = now.where("state = 'failed'"), SkippedSet(spark, root, batch_id)
        known = earlier.seeds()
        recovered = known.join(now.where("state <> 'failed'"), "tree_path", "left_semi")
        if not recovered.isEmpty():
            last = F.max_by(F.struct("state"), "seq").alias("l")
            rows = spark.read.schema(f"{fields}, batch int").option("basePath", f"{root}/output").parquet(f"{root}/output")
            failed = rows.where(F.col("batch") <= batch_id).groupBy("tree_path").agg(last).where("l.state = 'failed'")
            new, before = failed.select("tree_path"), earlier.none()
        else:
            new, before = failed.select("tree_path").join(known, "tree_path", "left_anti"), earlier.behind()
        found = None
        if not new.isEmpty():
            found = graph.grown(new.select(F.col("tree_path").alias("id")), before.select(F.col("tree_path").alias("id")))
        earlier.write(new, found, not recovered.isEmpty())

    query = keyed.start(live, root, "live_state", each=each, **trigger)
    query.graph = graph
    return query


class SkippedSet:
    """The failed targets and those behind them, batch by batch; a batch that starts anew hides earlier ones."""

    SCHEMA = "tree_path string, kind string, batch int"

    def __init__(self, spark: SparkSession, root: str, batch: int | None = None):
        self.spark, self.path, self.batch = spark, f"{root}/skipped", batch

    def rows(self) -> DataFrame:
        """(tree_path, kind) of the batches before this one (of all without one), since the last start."""
        try:
            rows = self.spark.read.schema(self.SCHEMA).option("basePath", self.path).parquet(self.path)
        except AnalysisException:  # before the first batch
            return self.spark.createDataFrame([], self.SCHEMA)
        if self.batch is not None:
            rows = rows.where(F.col("batch") < self.batch)
        anew = rows.where("kind = 'anew'").agg(F.max("batch")).first()[0]
        return rows if anew is None else rows.where(F.col("batch") >= anew)

    def none(self) -> DataFrame:
        return self.rows().limit(0).select("tree_path")

    def seeds(self) -> DataFrame:
        return self.rows().where("kind = 'failed'").select("tree_path")

    def behind(self) -> DataFrame:
        return self.rows().where("kind = 'behind'").select("tree_path")

    def write(self, failed: DataFrame, behind: DataFrame | None, anew: bool) -> None:
        out = failed.select("tree_path", F.lit("failed").alias("kind"))
        if behind is not None:
            out = out.unionByName(behind.select(F.col("id").alias("tree_path"), F.lit("behind").alias("kind")))
        if anew:
            out = out.unionByName(self.spark.createDataFrame([(None, "anew")], "tree_path string, kind string"))
        out.write.mode("overwrite").parquet(f"{self.path}/batch={self.batch}")


def live_state(spark: SparkSession, root: str) -> DataFrame:
    """(tree_path, seq, state, exit_code, both durations): the state of every target the stream has met."""
    fields = [f.split()[0] for f in LiveTarget.FIELDS.split(", ")]
    return keyed.state(spark, root, "live").select("key.tree_path", *[f"value.{f}" for f in fields])


def live_report(spark: SparkSession, root: str, targets: DataFrame) -> DataFrame:
    """All tracked targets with their live state, pending ones skipped behind failures."""
    known = live_state(spark, root).drop("seq")
    state = targets.join(known, "tree_path", "left")
    hit = SkippedSet(spark, root).behind().distinct().withColumn("_hit", F.lit(True))
    waiting = F.when(F.col("_hit"), "skipped").otherwise("pending")
    return state.join(hit, "tree_path", "left").withColumn("state", F.coalesce("state", waiting)).drop("_hit")


def throttle_stream(
    events: DataFrame, root: str, key: str, seconds: float, closing_s: float | None = None, timers: bool = False, **trigger
) -> StreamingQuery:
    """Stream of throttled updates (key, ts_us, seq, closing) below ``root/output``.

    The first event of a key and each that is due since the last emission come out at once.  A timer emits the last
    event of a key, if it was not due, ``closing_s`` (the interval, by default) after the key's last batch.
    """
    gap = int(seconds * 1_000_000)
    if gap <= 0:
        raise ValueError("seconds must be positive")
    wait = seconds if closing_s is None else closing_s
    schema = f"{key} {events.schema[key].dataType.simpleString()}, ts_us bigint, seq bigint, closing boolean"
    chosen = with_state(events.select(key, "ts_us", "seq"), [key], Throttle(key, gap, int(wait * 1000)), schema)
    return keyed.start(chosen, root, "throttle", timers, **trigger)


def throttled(rows: DataFrame, key: str) -> DataFrame:
    """The emissions of a throttled stream; closing updates that a later event has overtaken are left out.

    A closing update was the last event when its timer fired.  If the key went on afterwards, it has a later row.
    """
    last = rows.groupBy(key).agg(F.max(F.struct("ts_us", "seq")).alias("_last"))
    kept = rows.where("NOT closing").select(key, "ts_us", "seq")
    ends = rows.where("closing").groupBy(key).agg(F.max(F.struct("ts_us", "seq")).alias("_end"))
    both = ends.alias("e").join(last.alias("l"), F.col(f"e.{key}").eqNullSafe(F.col(f"l.{key}")))
    closing = both.where("_end = _last").select(F.col(f"e.{key}").alias(key), "_end.ts_us", "_end.seq")
    return kept.unionByName(closing)


def buffer_stream(
    lines: DataFrame, root: str, key: str = "tree_path", buffer: int = s.BUFFER_LINES, keep_s: float | None = None, **trigger
) -> StreamingQuery:
    """Last lines per key, kept in the stream's state; :func:`buffered` reads them.

    A key never holds more than ``buffer`` lines; with ``keep_s`` they go so long after the last one came.
    """
    keep = None if keep_s is None else int(keep_s * 1000)
    nothing = f"{key} {lines.schema[key].dataType.simpleString()}"
    rows = with_state(lines.select(key, "seq", "line"), [key], LastLines(buffer, keep), nothing)
    return keyed.start(rows, root, "line_buffer", **trigger)


def buffered(spark: SparkSession, root: str, key: str = "tree_path") -> DataFrame:
    """(key, seq, line): the lines in the state of a buffer stream."""
    return keyed.state(spark, root, "lines").select(F.col(f"key.{key}").alias(key), "list_element.seq", "list_element.line")


def finalize(
    events: DataFrame,
    targets: DataFrame,
    attempts: DataFrame,
    outputs: DataFrame,
    store: DataFrame,
    run_ok: bool,
    path: str,
) -> DataFrame:
    """End of a run over the landed events: retries, then resolution, then results files.

    Every target that never reported is decided by its outputs here, also one
    the live report showed as skipped.  Returns the rows as read back.
    """
    results = s.run_results(events, targets, attempts, outputs, store, run_ok)
    write_results(results.drop("backoff_s"), path)
    return read_result_rows(events.sparkSession, path)

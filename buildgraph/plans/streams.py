"""Streaming queries: the events table read as a stream, checked against the batch oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildgraph.functions.storage import fresh_path
from buildgraph.operators import attribution as a
from buildgraph.plans import logs
from buildgraph.plans import tables as t
from buildgraph.plans.registry import ORACLES, query
from buildgraph.streaming import keyed
from buildgraph.streaming import log as sl


PARTS = 3


def _in_parts(spark, sf_dir, consume):
    """Land the events in three parts by id and run the stream after each.

    A part is one micro-batch, however many files it has, and state carries over.
    """
    events = t.table(spark, sf_dir, "events")
    ends = events.agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).first()
    low, width = ends["a"] or 0, ((ends["b"] or 0) - (ends["a"] or 0)) // PARTS + 1
    path = fresh_path(spark, "landing")
    for part in range(PARTS):
        inside = F.col("event_id").between(low + part * width, low + (part + 1) * width - 1)
        events.filter(inside).write.parquet(f"{path}/part-{part}")
        consume(spark.readStream.schema(events.schema).parquet(f"{path}/part-*"), part == PARTS - 1)


@query(ORACLES["attribute_log"])
def stream_attribute_log(spark, sf_dir):
    root, targets = fresh_path(spark, "stream"), t.log_targets(spark, sf_dir)
    _in_parts(spark, sf_dir, lambda rows, last: sl.attribute_stream(t.log_of(rows), targets, root).awaitTermination())
    return keyed.output(spark, root).drop("run", "ts_us")


@query(f"""WITH RECURSIVE {t.LOG}, {logs.DURATIONS},
hit(id) AS (SELECT tree_path FROM states WHERE state = 'failed'
  UNION SELECT e.src FROM hit h JOIN tedges e ON e.dst = h.id)
SELECT s.tree_path, s.drv_path, s.exit_code, duration_latest_ms,
  coalesce(duration_total_ms, CASE WHEN state <> 'pending' THEN 0 END) AS duration_total_ms,
  CASE WHEN state = 'pending' AND s.tree_path IN (SELECT id FROM hit) THEN 'skipped' ELSE state END AS state
FROM states s LEFT JOIN times t ON t.tree_path = s.tree_path""")
def stream_live_state(spark, sf_dir):
    """Two streams in a row: attribution, then the state fold over its output, part by part."""
    first, second = fresh_path(spark, "stream"), fresh_path(spark, "stream")
    targets = t.log_targets(spark, sf_dir)

    def consume(rows, last):
        sl.attribute_stream(t.log_of(rows), targets, first).awaitTermination()
        source = spark.readStream.schema(keyed.output(spark, first).schema).parquet(f"{first}/output")
        sl.live_state_stream(source, second, t.tracked_edges(spark, sf_dir)).awaitTermination()

    _in_parts(spark, sf_dir, consume)
    return sl.live_report(spark, second, t.tracked(spark, sf_dir))


@query(ORACLES["throttle"])
def stream_throttle(spark, sf_dir):
    """Throttled updates; the closing ones come from timers, which the last part waits for."""
    root = fresh_path(spark, "stream")

    def consume(rows, last):
        events = rows.select(
            "user_id",
            F.unix_micros(F.col("ts").cast("timestamp_ltz")).alias("ts_us"),
            F.col("event_id").alias("seq"),
        )
        query = sl.throttle_stream(events, root, "user_id", 86_400, closing_s=1, timers=last)
        keyed.drain(query, 1_000) if last else query.awaitTermination()

    _in_parts(spark, sf_dir, consume)
    return sl.throttled(keyed.output(spark, root), "user_id")


@query(ORACLES["line_buffer"])
def stream_line_buffer(spark, sf_dir):
    root = fresh_path(spark, "stream")

    def consume(rows, last):
        lines = t.log_of(rows).filter("type = 101").select("id", "seq", F.col("arg_text").alias("line"))
        sl.buffer_stream(lines, root, "id", 5).awaitTermination()

    _in_parts(spark, sf_dir, consume)
    return sl.buffered(spark, root, "id")


@query(f"""WITH {t.LOG}, {logs.DURATIONS}, {logs.ATTEMPTS},
last AS (SELECT tree_path, arg_max(status, seq) AS status, arg_max(struct_pack(c := exit_code), seq).c AS exit_code
  FROM attributed WHERE status IN ('failed', 'succeeded') GROUP BY tree_path),
b AS (SELECT t.tree_path, t.drv_path, coalesce(l.status, 'pending') AS status, l.exit_code, d.duration_latest_ms AS ms0,
  g.log, g.tail, w.k, w.ms FROM tracked t LEFT JOIN last l USING (tree_path) LEFT JOIN times d USING (tree_path)
  LEFT JOIN logs g USING (tree_path) LEFT JOIN won w USING (tree_path)),
c AS (SELECT *, status = 'failed' AND log IS NOT NULL AS tried,
  status = 'failed' AND contains(coalesce(log, ''), 'curl error') AS transient FROM b)
SELECT tree_path, drv_path, CASE WHEN transient AND k IS NOT NULL THEN 'succeeded'
    WHEN status = 'pending' AND drv_path LIKE '%7' THEN 'skipped' WHEN status = 'pending' THEN 'succeeded' ELSE status END AS status,
  CASE WHEN transient AND k IS NOT NULL THEN 0 ELSE exit_code END AS exit_code,
  CASE WHEN transient AND k IS NOT NULL THEN coalesce(ms0, 0) + ms ELSE ms0 END AS duration_ms,
  CASE WHEN transient THEN coalesce(k, 3) END AS retry_count,
  CASE WHEN tried AND NOT (transient AND k IS NOT NULL) THEN tail END AS log_tail FROM c""")
def finalize(spark, sf_dir):
    """A finished run: attributed events folded into results files and read back."""
    events = a.attribute_log(t.log(spark, sf_dir), t.log_targets(spark, sf_dir))
    tracked = t.tracked(spark, sf_dir).withColumn("system", F.lit("x86_64-linux"))
    drv = F.col("drv_path")
    outputs = tracked.select(drv, t.text("out-", drv).alias("path"))
    store = outputs.filter(~F.col("path").endswith("7")).select("path")
    path = fresh_path(spark, "run")
    rows = sl.finalize(events, tracked, logs.attempts_of(events), outputs, store, False, path)
    return rows.select(
        "tree_path", "drv_path", "status", "exit_code", "duration_ms", "retry_count", "log_tail"
    )

"""Queries over the build log."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildgraph.functions.storage import materialize
from buildgraph.operators import attribution as a
from buildgraph.operators import state as s
from buildgraph.operators.graph import propagate_skips as spread_skips
from buildgraph.operators.throttle import throttle as throttle_events
from buildgraph.plans import tables as t
from buildgraph.plans.registry import query


def _events(spark, sf_dir, lines=True):
    return a.attribute_log(t.log(spark, sf_dir), t.log_targets(spark, sf_dir), lines=lines)


def _states(spark, sf_dir):
    return s.final_state(_events(spark, sf_dir, lines=False), t.tracked(spark, sf_dir))


@query(f"WITH {t.LOG} SELECT seq, tree_path, drv_path, system, status, exit_code, line FROM attributed")
def attribute_log(spark, sf_dir):
    return _events(spark, sf_dir).drop("run", "ts_us")


@query(f"""WITH {t.LOG},
ranked AS (SELECT tree_path, seq, line, row_number() OVER (PARTITION BY tree_path ORDER BY seq DESC) AS rn
  FROM attributed WHERE status = 'line')
SELECT tree_path, string_agg(line, chr(10) ORDER BY seq) FILTER (rn <= 200) AS log,
  string_agg(line, chr(10) ORDER BY seq) FILTER (rn <= 20) AS log_tail FROM ranked GROUP BY tree_path""")
def log_tail(spark, sf_dir):
    return s.log_tail(_events(spark, sf_dir).filter("status = 'line'"))


@query(f"""WITH {t.LOG},
ranked AS (SELECT id, seq, line, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn
  FROM log WHERE kind = 'click') SELECT id, seq, line FROM ranked WHERE rn <= 5""")
def line_buffer(spark, sf_dir):
    lines = t.log(spark, sf_dir).filter("type = 101")
    return s.line_buffer(lines.select("id", "seq", F.col("arg_text").alias("line")), 5, key="id")


THROTTLE = """WITH RECURSIVE ev AS (SELECT {key} AS k, event_id AS seq, epoch_us(ts) AS us FROM events),
chain(k, us) AS (
  SELECT k, min(us) FROM ev GROUP BY k
  UNION ALL
  SELECT k, nxt FROM (SELECT c.k, (SELECT min(e.us) FROM ev e WHERE e.k = c.k AND e.us >= c.us + {gap}) AS nxt
    FROM chain c) WHERE nxt IS NOT NULL)
SELECT ev.k AS {key}, ev.us AS ts_us, ev.seq FROM ev JOIN chain c ON c.k = ev.k AND c.us = ev.us
UNION SELECT k, max(us), max(seq) FROM ev GROUP BY k"""


def _timed(spark, sf_dir, key):
    return t.table(spark, sf_dir, "events").select(
        key,
        F.unix_micros(F.col("ts").cast("timestamp_ltz")).alias("ts_us"),
        F.col("event_id").alias("seq"),
    )


@query(THROTTLE.format(key="user_id", gap=86_400_000_000))
def throttle(spark, sf_dir):
    return throttle_events(_timed(spark, sf_dir, "user_id"), ["user_id"], 86_400)


@query(THROTTLE.format(key="event_type", gap=6 * 3_600_000_000))
def throttle_large_keys(spark, sf_dir):
    """Five keys hold all rows, so the path for large keys is taken."""
    rows = _timed(spark, sf_dir, "event_type")
    return throttle_events(rows, ["event_type"], 6 * 3_600, fold_rows=256)


ATTEMPTS = """
attempts AS (SELECT tree_path, k, (s + k) % 4 = 0 AS ok, 100 * k + s % 7 AS ms
  FROM (SELECT tree_path, max(seq) AS s FROM attributed WHERE status = 'failed' GROUP BY tree_path),
  (VALUES (1), (2), (3), (4)) v(k)),
won AS (SELECT tree_path, min(k) AS k, arg_min(ms, k) AS ms FROM attempts WHERE ok AND k <= 3 GROUP BY tree_path),
ranked AS (SELECT tree_path, seq, line, row_number() OVER (PARTITION BY tree_path ORDER BY seq DESC) AS rn
  FROM attributed WHERE status = 'line'),
logs AS (SELECT tree_path, string_agg(line, chr(10) ORDER BY seq) FILTER (rn <= 200) AS log,
  string_agg(line, chr(10) ORDER BY seq) FILTER (rn <= 20) AS tail FROM ranked GROUP BY tree_path),
base AS (SELECT s.tree_path, s.drv_path, CASE WHEN s.state = 'building' THEN 'failed' ELSE s.state END AS status,
  s.exit_code, log, tail FROM states s LEFT JOIN logs l ON l.tree_path = s.tree_path),
folded AS (SELECT b.*, w.k, w.ms, b.status = 'failed' AND log IS NOT NULL AS tried,
  b.status = 'failed' AND contains(coalesce(log, ''), 'curl error') AS transient
  FROM base b LEFT JOIN won w ON w.tree_path = b.tree_path)"""


def attempts_of(events):
    k, at = F.col("attempt"), F.col("s")
    failed = events.filter("status = 'failed'").groupBy("tree_path").agg(F.max("seq").alias("s"))
    tries = F.array(*[F.lit(i) for i in range(1, 5)])
    return failed.withColumn("attempt", F.explode(tries)).select(
        "tree_path",
        "attempt",
        ((at + k) % 4 == 0).alias("ok"),
        (100 * k + at % 7).alias("duration_ms"),
    )


def _base(spark, sf_dir):
    events = materialize(_events(spark, sf_dir), "events")
    logs = s.log_tail(events.filter("status = 'line'")).select("tree_path", "log")
    states = s.final_state(events, t.tracked(spark, sf_dir)).withColumn(
        "status", F.when(F.col("state") == "building", "failed").otherwise(F.col("state"))
    )
    base = states.drop("state").join(logs, "tree_path", "left")
    return base.withColumn("duration_ms", F.lit(1000).cast("bigint")), attempts_of(events)


@query(f"""WITH {t.LOG}, {ATTEMPTS}
SELECT tree_path, CASE WHEN transient AND k IS NOT NULL THEN 'succeeded' ELSE status END AS status,
  CASE WHEN transient AND k IS NOT NULL THEN 0 ELSE exit_code END AS exit_code,
  CASE WHEN transient AND k IS NOT NULL THEN 1000 + ms ELSE 1000 END AS duration_ms,
  CASE WHEN transient THEN coalesce(k, 3) END AS retry_count,
  CASE WHEN tried AND NOT (transient AND k IS NOT NULL) THEN tail END AS log_tail,
  CASE WHEN transient THEN 5 * coalesce(k, 3) * (coalesce(k, 3) + 1) // 2 ELSE 0 END::BIGINT AS backoff_s FROM folded""")
def apply_retries(spark, sf_dir):
    return s.apply_retries(*_base(spark, sf_dir)).drop("drv_path", "log")


@query(f"WITH {t.LOG} SELECT tree_path, drv_path, state, exit_code FROM states")
def final_state(spark, sf_dir):
    return _states(spark, sf_dir)


@query(f"""WITH RECURSIVE {t.LOG},
hit(id) AS (SELECT tree_path FROM states WHERE state = 'failed'
  UNION SELECT e.src FROM hit h JOIN tedges e ON e.dst = h.id)
SELECT tree_path, drv_path, exit_code, CASE WHEN state = 'pending' AND tree_path IN (SELECT id FROM hit)
  THEN 'skipped' ELSE state END AS state FROM states""")
def propagate_skips(spark, sf_dir):
    return spread_skips(_states(spark, sf_dir), t.tracked_edges(spark, sf_dir))


@query(f"""WITH {t.LOG},
outputs AS (SELECT drv_path, 'out-' || drv_path AS path FROM tracked WHERE drv_path NOT LIKE '%7'
  UNION ALL SELECT drv_path, 'dev-' || drv_path FROM tracked WHERE drv_path LIKE '%3'),
store AS (SELECT path FROM outputs WHERE path NOT LIKE '%5' AND path NOT LIKE 'dev-x1%'),
bad AS (SELECT DISTINCT drv_path FROM outputs WHERE path NOT IN (SELECT path FROM store))
SELECT tree_path, drv_path, exit_code, CASE WHEN state <> 'pending' THEN state
  WHEN drv_path IN (SELECT drv_path FROM bad) THEN 'skipped' ELSE 'succeeded' END AS status FROM states""")
def resolve_pending(spark, sf_dir):
    states = _states(spark, sf_dir).withColumnRenamed("state", "status")
    drv = F.col("drv_path")
    tracked = t.tracked(spark, sf_dir).select("drv_path")
    outs = tracked.filter(~drv.endswith("7")).select(drv, t.text("out-", drv).alias("path"))
    devs = tracked.filter(drv.endswith("3")).select(drv, t.text("dev-", drv).alias("path"))
    outputs = outs.unionByName(devs)
    path = F.col("path")
    store = outputs.filter(~path.endswith("5") & ~path.startswith("dev-x1")).select("path")
    return s.resolve_pending(states, outputs, store, run_ok=False)


@query(f"""WITH {t.LOG}
SELECT split_part(tree_path, '/', 1) AS folder, count(*) FILTER (state = 'pending') AS pending,
  count(*) FILTER (state = 'building') AS building, count(*) FILTER (state = 'succeeded') AS succeeded,
  count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'skipped') AS skipped,
  count(*) FILTER (state IN ('failed', 'skipped')) AS failures FROM states GROUP BY 1""")
def state_counts(spark, sf_dir):
    states = _states(spark, sf_dir).withColumn("folder", F.substring_index("tree_path", "/", 1))
    return s.state_counts(states, ["folder"])


@query(f"""WITH {t.LOG}
SELECT split_part(tree_path, '/', 3) AS slot, bool_and(state = 'succeeded') AS success
FROM states WHERE tree_path LIKE 'pkg/%' GROUP BY 1
UNION ALL SELECT 'none', coalesce(bool_and(state = 'succeeded'), true) FROM states WHERE state = 'lost'""")
def all_succeeded(spark, sf_dir):
    states = _states(spark, sf_dir).withColumn("slot", F.substring_index("tree_path", "/", -1))
    some = s.all_succeeded(states.filter("tree_path LIKE 'pkg/%'"), ["slot"], "state")
    none = s.all_succeeded(states.filter("state = 'lost'"), [], "state")
    return some.unionByName(none.select(F.lit("none").alias("slot"), "success"))


DURATIONS = """
live AS (SELECT *, status <> 'started' AS r FROM attributed WHERE status <> 'line'),
spans AS (SELECT *, coalesce(sum(r::INT) OVER (PARTITION BY tree_path ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM live),
closed AS (SELECT tree_path, span, min(ts_us) FILTER (NOT r) AS a, max(ts_us) FILTER (NOT r) AS b,
  max(ts_us) FILTER (r) AS z FROM spans GROUP BY ALL HAVING max(ts_us) FILTER (r) IS NOT NULL),
times AS (SELECT tree_path,
  CAST((max(z) - max(b)) // 1000 AS BIGINT) AS duration_latest_ms,
  CAST(coalesce(sum((z - a) // 1000), 0) AS BIGINT) AS duration_total_ms FROM closed GROUP BY tree_path)"""


@query(f"WITH {t.LOG}, {DURATIONS} SELECT * FROM times")
def durations(spark, sf_dir):
    return s.durations(_events(spark, sf_dir, lines=False))


@query(f"""WITH {t.LOG}, r AS (SELECT tree_path, exit_code, 'tail of ' || tree_path AS log_tail FROM attributed
  WHERE status = 'failed' QUALIFY row_number() OVER (PARTITION BY tree_path ORDER BY seq DESC) = 1)
SELECT s.tree_path, s.drv_path, s.state, r.exit_code, r.log_tail FROM states s LEFT JOIN r ON r.tree_path = s.tree_path""")
def join_results(spark, sf_dir):
    events = _events(spark, sf_dir, lines=False)
    results = (
        events.filter("status = 'failed'")
        .groupBy("tree_path")
        .agg(F.max_by("exit_code", "seq").alias("exit_code"))
        .withColumn("log_tail", t.text("tail of ", F.col("tree_path")))
    )
    return s.join_results(s.final_state(events, t.tracked(spark, sf_dir)), results)

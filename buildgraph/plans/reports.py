"""Queries over results: owners, reports, generated steps, round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildgraph.functions.storage import fresh_path
from buildgraph.operators import owners as o
from buildgraph.operators import reports as r
from buildgraph.operators.chunking import chunk_number
from buildgraph.plans import tables as t
from buildgraph.plans.registry import query
from buildgraph.sources.readers import read_result_rows
from buildgraph.sources.writers import write_results

OWNERS = """
failed AS (SELECT *, CASE WHEN NOT has_owner THEN 'unknown' ELSE coalesce(discord, github, 'unknown') END AS owner,
  CASE WHEN has_owner THEN discord_id END AS oid FROM results WHERE status = 'failed')"""


@query(f"""WITH {t.RESULTS}, {OWNERS}
SELECT owner, max(oid) AS owner_id, count(*) AS n_failed,
  (SELECT string_agg(DISTINCT system, ', ' ORDER BY system) FROM results) AS systems FROM failed GROUP BY owner""")
def failures_by_owner(spark, sf_dir):
    return o.failures_by_owner(t.results(spark, sf_dir))


@query(f"""WITH {t.RESULTS}, {OWNERS}
SELECT owner, count(*) OVER (PARTITION BY owner) AS n_failed, tree_path, system, exit_code,
  '(exit ' || exit_code || ')' AS exit_text FROM failed""")
def owner_failures(spark, sf_dir):
    return o.owner_failures(t.results(spark, sf_dir))


@query(f"""WITH {t.RESULTS}
SELECT 'all' AS run, count(*) AS targets FROM results HAVING count(*) FILTER (status = 'failed') = 0
UNION ALL SELECT 'built', count(*) FROM results WHERE status <> 'failed'""")
def success_summary(spark, sf_dir):
    rows = t.results(spark, sf_dir)
    everything = o.success_summary(rows).select(F.lit("all").alias("run"), "targets")
    built = o.success_summary(rows.filter("status <> 'failed'"))
    return everything.unionByName(built.select(F.lit("built").alias("run"), "targets"))


def _state(spark, sf_dir):
    return t.results(spark, sf_dir).withColumns(
        {"state": F.col("status"), "elapsed_ms": F.lit(None).cast("bigint")}
    )


@query(f"""WITH {t.RESULTS}
SELECT tree_path, CASE status WHEN 'failed' THEN ':x:' WHEN 'succeeded' THEN ':white_check_mark:'
    ELSE ':no_entry_sign:' END AS icon, badge, duration_ms, CASE WHEN status <> 'skipped' THEN printf('%.1fs', duration_ms / 1000.0) ELSE '—' END AS duration_text,
  CASE WHEN NOT has_owner THEN '—' ELSE coalesce(github, discord, '?') END AS owner_names FROM results""")
def status_report(spark, sf_dir):
    return r.status_report(_state(spark, sf_dir))


@query(f"""WITH {t.RESULTS}, c AS (SELECT system, count(*) FILTER (status = 'succeeded') AS ok,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM results GROUP BY 1)
SELECT system, 0::BIGINT AS pending, 0::BIGINT AS building, ok AS succeeded, failed, skipped, failed + skipped AS failures,
  '### Build: ' || system || ' — ' || ok || ' succeeded, ' || (failed + skipped) || ' failed'
  || CASE WHEN skipped > 0 THEN ' (' || skipped || ' skipped: dependency failure)' ELSE '' END AS headline FROM c""")
def report_header(spark, sf_dir):
    return r.report_header(_state(spark, sf_dir))


@query(f"""WITH {t.RESULTS}
SELECT status AS state, tree_path, badge,
  CASE WHEN status = 'skipped' THEN 'skipped (dependency failure)' ELSE 'exit code ' || exit_code END AS reason,
  CASE WHEN NOT has_owner THEN 'none' ELSE '@' || coalesce(github, discord, '?') END AS owner_names, log_tail
FROM results WHERE status IN ('failed', 'skipped')""")
def failure_report(spark, sf_dir):
    return r.failure_report(_state(spark, sf_dir))


def _extra(spark, sf_dir):
    k = F.col("o_orderkey")
    return t.table(spark, sf_dir, "orders").select(
        t.text("deploy-", k % 5).alias("label"),
        t.text("order/", k).alias("parent_label"),
        t.text("drv-", k).alias("parent_key"),
        F.when(k % 4 == 0, "Target has not changed.").alias("parent_skip"),
        F.when(k % 6 == 0, "by hand").alias("own_skip"),
        (k % 5 == 0).alias("always_run"),
        (k % 7 == 0).alias("needs_output"),
    )


@query("""SELECT 'extra-step-' || sha1('deploy-' || (o_orderkey % 5) || '-order/' || o_orderkey) AS key,
  ':gear: deploy-' || (o_orderkey % 5) || ' (from order/' || o_orderkey || ')' AS label,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN 'by hand'
    WHEN o_orderkey % 4 = 0 THEN 'Target has not changed.' END AS skip,
  CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN 'drv-' || o_orderkey END AS depends_on FROM orders""")
def extra_steps(spark, sf_dir):
    return r.extra_steps(_extra(spark, sf_dir))


@query("""WITH s AS (SELECT o_orderkey AS k, 'o' || o_orderkey AS key,
    CASE o_orderkey % 3 WHEN 0 THEN 'build' WHEN 1 THEN 'release' ELSE 'deploy' END AS phase, false AS g FROM orders
  UNION ALL SELECT c_custkey, 'c' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'build' ELSE 'release' END, true FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY g, k, key) AS position FROM s WHERE phase IN ('build', 'release'))
SELECT phase, CASE phase WHEN 'build' THEN 1 ELSE 2 END AS phase_order, position, key, position // 192 + 1 AS chunk FROM n""")
def steps_by_phase(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    own = t.table(spark, sf_dir, "orders").select(
        t.text("o", k).alias("key"),
        F.when(k % 3 == 0, "build").when(k % 3 == 1, "release").otherwise("deploy").alias("phase"),
        F.lit(False).alias("is_global"),
        k.alias("target_pos"),
        F.lit(0).alias("step_pos"),
    )
    shared = t.table(spark, sf_dir, "customer").select(
        t.text("c", c).alias("key"),
        F.when(c % 2 == 0, "build").otherwise("release").alias("phase"),
        F.lit(True).alias("is_global"),
        c.alias("target_pos"),
        F.lit(0).alias("step_pos"),
    )
    steps = r.steps_by_phase(own.unionByName(shared), ["build", "release"], ["release", "build"])
    return steps.withColumn("chunk", chunk_number("position"))


RESULT_COLS = ("tree_path", "drv_path", "system", "status", "exit_code", "duration_ms", "log_tail")


@query(f"""WITH {t.RESULTS}
SELECT tree_path, '/nix/store/' || lpad(k::VARCHAR, 32, '0') || '-order' AS drv_path, system,
  status, exit_code, duration_ms, log_tail,
  CASE WHEN has_owner THEN coalesce(github, discord, '?') ELSE '—' END AS owner FROM results""")
def results_round_trip(spark, sf_dir):
    path = fresh_path(spark, "results")
    write_results(t.results(spark, sf_dir), path)
    back = read_result_rows(spark, path)
    return back.select(*RESULT_COLS, r.owner_names("owners").alias("owner"))

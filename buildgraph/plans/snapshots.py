"""Queries over target snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildgraph.functions.storage import fresh_path
from buildgraph.operators import diff as d
from buildgraph.plans import tables as t
from buildgraph.plans.registry import query
from buildgraph.sources.readers import parse_snapshots
from buildgraph.sources.writers import snapshot_json, write_snapshot

ROW = ("tree_path", "drv_path", "system", "dev_attr_type")


def _pair(spark, sf_dir):
    p, c = t.snapshots(spark, sf_dir)
    return p.select(*ROW), c.select(*ROW)


def _diff(spark, sf_dir):
    return d.diff_snapshots(*_pair(spark, sf_dir))


@query(f"WITH {t.DIFF} SELECT * FROM diff")
def snapshot_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


@query(f"""WITH {t.SNAPSHOTS}
SELECT tree_path, drv_path, system, dev_attr_type FROM current c
WHERE NOT EXISTS (SELECT 1 FROM parent p WHERE p.tree_path = c.tree_path AND p.drv_path = c.drv_path)""")
def changed_targets(spark, sf_dir):
    return d.changed_targets(*_pair(spark, sf_dir))


@query(f"WITH {t.DIFF} SELECT * FROM diff WHERE change IN ('added', 'changed')")
def to_build(spark, sf_dir):
    return d.to_build(_diff(spark, sf_dir))


@query(f"WITH {t.DIFF} SELECT * FROM diff WHERE change = 'removed'")
def removed(spark, sf_dir):
    return d.removed(_diff(spark, sf_dir))


@query(f"""WITH {t.SNAPSHOTS}
SELECT tree_path, drv_path, system, dev_attr_type FROM current
WHERE tree_path NOT IN (SELECT 'part/' || (p_partkey * 10 + n) FROM part, range(10) r(n) WHERE p_brand = 'Brand#7')""")
def subtract(spark, sf_dir):
    excluded = t.table(spark, sf_dir, "part").filter("p_brand = 'Brand#7'")
    excluded = excluded.select(F.explode(F.sequence(F.col("p_partkey") * 10, F.col("p_partkey") * 10 + 9)).alias("k"))
    excluded = excluded.select(t.text("part/", F.col("k")).alias("tree_path"))
    return d.subtract(_pair(spark, sf_dir)[1], excluded, "tree_path")


@query(f"""WITH {t.SNAPSHOTS}
SELECT coalesce(system, '') AS system, count(*) AS targets FROM current GROUP BY 1""")
def by_system(spark, sf_dir):
    return d.by_system(_pair(spark, sf_dir)[1])


@query(f"""WITH {t.DIFF}
SELECT change AS measure, NULL::VARCHAR AS system, count(*) AS targets FROM diff GROUP BY 1
UNION ALL SELECT 'to_build', NULL, count(*) FROM diff WHERE change IN ('added', 'changed')
UNION ALL SELECT 'to_build', coalesce(system, ''), count(*) FROM diff
  WHERE change IN ('added', 'changed') GROUP BY 2""")
def diff_summary(spark, sf_dir):
    return d.diff_summary(_diff(spark, sf_dir))


@query(f"""WITH {t.SNAPSHOTS}
SELECT tree_path, drv_path, system, dev_attr_type FROM current WHERE system = 'aarch64-linux'""")
def scope_system(spark, sf_dir):
    return d.scope_system(_pair(spark, sf_dir)[1], "aarch64-linux")


@query(f"""WITH {t.SNAPSHOTS}
SELECT tree_path, drv_path, system, dev_attr_type FROM current
WHERE system IS NULL OR system = 'x86_64-linux'""")
def scope_platform(spark, sf_dir):
    return d.scope_platform(_pair(spark, sf_dir)[1], "x86_64-linux")


@query(f"""WITH {t.DIFF},
sizes AS (SELECT coalesce(system, '') AS system, count(*) AS n FROM diff
  WHERE change IN ('added', 'changed') GROUP BY 1),
steps AS (SELECT ':nix: build ' || system || ' (' || n || ')' AS label,
  'build-' || replace(system, '.', '-') AS key,
  CASE WHEN system LIKE '%-darwin' THEN 'no macOS Buildkite agent available' END AS skip,
  'pipeline-gen' AS depends_on,
  CASE WHEN system LIKE '%-%' THEN split_part(system, '-', 1) ELSE 'unknown' END AS arch,
  CASE WHEN system LIKE '%-%' THEN split_part(system, '-', 2) ELSE system END AS os, system FROM sizes)
SELECT * FROM steps
UNION ALL SELECT ':point_up: post-build', 'ci-post-build', NULL, string_agg(key, ',' ORDER BY key),
  NULL, NULL, NULL FROM steps HAVING count(*) > 0""")
def system_plan(spark, sf_dir):
    plan = d.system_plan(d.to_build(_diff(spark, sf_dir)))
    return plan.withColumn("depends_on", F.array_join("depends_on", ","))


@query(f"""WITH {t.SNAPSHOTS}
SELECT tree_path, '/nix/store/' || k || '-out' AS output FROM current
UNION ALL SELECT tree_path, '/nix/store/' || k || '-dev' FROM current WHERE p_size % 2 <> 0 OR p_size IS NULL""")
def output_roots(spark, sf_dir):
    return d.output_roots(t.snapshots(spark, sf_dir)[1])


@query(f"""WITH {t.SNAPSHOTS}
SELECT c.tree_path, c.system AS declared, CASE WHEN k % 5 = 0 THEN 'x86_64-linux' ELSE c.system END AS derived
FROM current c WHERE k % 5 = 0 AND (c.system IS NULL OR c.system <> 'x86_64-linux')""")
def mismatches(spark, sf_dir):
    current = t.snapshots(spark, sf_dir)[1]
    key = F.element_at("attr_path", 2).cast("bigint")
    derived = current.withColumn(
        "system", F.when(key % 5 == 0, "x86_64-linux").otherwise(F.col("system"))
    )
    return d.mismatches(current, derived)


@query(f"""WITH {t.SNAPSHOTS}
SELECT 'full' AS side, tree_path, drv_path, system, dev_attr_type FROM current
UNION ALL SELECT 'changed', tree_path, drv_path, system, dev_attr_type FROM current c
WHERE NOT EXISTS (SELECT 1 FROM parent p WHERE p.tree_path = c.tree_path AND p.drv_path = c.drv_path)""")
def snapshot_round_trip(spark, sf_dir):
    parent, current = t.snapshots(spark, sf_dir)
    path = fresh_path(spark, "snapshot")
    write_snapshot(current, d.changed_targets(parent, current), path)
    sides = [
        spark.read.parquet(f"{path}/{side}").select(F.lit(side).alias("side"), *ROW)
        for side in ("full", "changed")
    ]
    return sides[0].unionByName(sides[1])


@query(f"""WITH {t.DIFF}
SELECT tree_path, drv_path, system, dev_attr_type FROM diff WHERE change IN ('added', 'changed')""")
def snapshot_documents(spark, sf_dir):
    """Changed targets written as JSON members, one document per target, and read back."""
    parent, current = t.snapshots(spark, sf_dir)
    rich = d.changed_targets(parent, current).withColumns(
        {
            "owners": F.array().cast(t.OWNER_TYPE),
            "deps": F.array().cast("array<string>"),
        }
    )
    members = snapshot_json(rich)
    path = fresh_path(spark, "documents")
    body = F.concat(F.lit('{"'), "tree_path", F.lit('": '), "json", F.lit("}"))
    members.select(body.alias("value")).write.text(path)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")
    )
    return parse_snapshots(lines).select(*ROW)

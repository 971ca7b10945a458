"""Queries over version pins and lockfiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildgraph.operators import pins as p
from buildgraph.operators.lookup import merge_right as merge
from buildgraph.plans import tables as t
from buildgraph.plans.registry import query
from buildgraph.sources.readers import flatten_lockfiles

PINS = """
pins AS (SELECT p_partkey AS k, replace(p_name, ' ', '-') || '-' || p_partkey AS base,
  CASE WHEN p_partkey % 2 = 0 THEN '@' || replace(lower(p_brand), '#', '') || '/' ELSE '' END
    || replace(p_name, ' ', '-') || '-' || p_partkey AS npm_name,
  p_size || '.0' AS pinned, (p_size + (p_partkey % 3 = 0)::INT) || '.0' AS latest, p_size FROM part)"""


def _pins(spark, sf_dir):
    k = F.col("p_partkey")
    base = t.text(F.replace("p_name", F.lit(" "), F.lit("-")), "-", k)
    scope = F.when(
        k % 2 == 0, t.text("@", F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), "/")
    ).otherwise("")
    return t.table(spark, sf_dir, "part").select(
        k.alias("k"),
        "p_size",
        base.alias("dir_name"),
        F.concat(scope, base).alias("npm_name"),
        t.text(F.col("p_size"), ".0").alias("pinned_version"),
    )


def _registry(pins):
    k = F.col("k")
    latest = t.text(F.col("p_size") + (k % 3 == 0).cast("int"), ".0")
    gone = k % 11 == 0
    return pins.filter(k % 22 != 0).select(
        "npm_name",
        F.when(~gone, latest).alias("latest"),
        F.when(gone, "HTTP 404").alias("error"),
    )


def _installed(pins):
    return pins.filter(F.col("k") % 7 != 0).select("npm_name", t.text(F.col("p_size"), ".0").alias("version"))


@query(f"""WITH {PINS}
SELECT npm_name AS package, pinned, CASE WHEN k % 22 = 0 THEN 'ERR (no registry document)'
  WHEN k % 11 = 0 THEN 'ERR (HTTP 404)' ELSE latest END AS latest,
  CASE WHEN k % 7 = 0 THEN '-' ELSE pinned END AS installed FROM pins""")
def version_status(spark, sf_dir):
    pins = _pins(spark, sf_dir)
    return p.version_status(pins, _registry(pins), _installed(pins))


@query(f"""WITH {PINS}
SELECT 'latest' AS against, npm_name, pinned, CASE WHEN k % 11 <> 0 THEN latest END AS reference,
  CASE WHEN k % 11 = 0 THEN 2 ELSE 1 END AS severity,
  CASE WHEN k % 22 = 0 THEN 'no registry document' WHEN k % 11 = 0 THEN 'HTTP 404' END AS reason
FROM pins WHERE k % 11 = 0 OR k % 3 = 0
UNION ALL SELECT 'installed', npm_name, pinned, '<not installed>', 1, NULL FROM pins WHERE k % 7 = 0""")
def check_pins(spark, sf_dir):
    pins = _pins(spark, sf_dir)
    latest = p.check_pins(pins, _registry(pins), "latest").withColumn("against", F.lit("latest"))
    installed = p.check_pins(pins, _installed(pins), "installed")
    return latest.unionByName(installed.withColumn("against", F.lit("installed")))


@query(f"""WITH {PINS} SELECT 'latest' AS against, max(CASE WHEN k % 11 = 0 THEN 2 ELSE 1 END) AS exit_code
  FROM pins WHERE k % 11 = 0 OR k % 3 = 0
UNION ALL SELECT 'installed', max(1) FROM pins WHERE k % 7 = 0
UNION ALL SELECT 'self', 0""")
def exit_severity(spark, sf_dir):
    pins = _pins(spark, sf_dir)
    same = pins.select("npm_name", F.col("pinned_version").alias("version"))
    findings = {
        "latest": p.check_pins(pins, _registry(pins), "latest"),
        "installed": p.check_pins(pins, _installed(pins), "installed"),
        "self": p.check_pins(pins, same, "installed"),
    }
    out = [
        p.exit_severity(f).select(F.lit(name).alias("against"), "exit_code")
        for name, f in findings.items()
    ]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _lock(spark, sf_dir):
    """Orders as lockfiles, their line items as package entries."""
    o, n, q = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    return t.table(spark, sf_dir, "lineitem").select(
        o.alias("file"),
        t.text("node_modules/a/node_modules/lib-", n).alias("key"),
        t.text("lib-", n).alias("name"),
        F.when(q != 7, t.text(q, ".0")).alias("version"),
        F.when(F.col("l_returnflag") != "R", t.text("https://registry.npmjs.org/lib-", n))
        .otherwise("git+ssh://x")
        .alias("resolved"),
        F.when(n % 5 != 0, t.text("sha512-own", n)).alias("integrity"),
        (n % 5 != 0).alias("has_integrity"),
    ).distinct()


@query("""WITH lock AS (SELECT DISTINCT l_orderkey AS file, l_partkey AS n, l_linenumber AS q, l_returnflag AS f FROM lineitem),
w AS (SELECT *, n % 5 = 0 AND f <> 'R' AND q <> 7 AS wanted FROM lock)
SELECT file, 'lib-' || n AS name, CASE WHEN q <> 7 THEN q || '.0' END AS version,
  CASE WHEN n % 5 <> 0 THEN 'sha512-own' || n WHEN wanted AND n % 15 <> 0 THEN 'sha512-' || n || '-' || q END AS integrity,
  CASE WHEN NOT wanted THEN 'untouched' WHEN n % 15 <> 0 THEN 'fixed' ELSE 'missing' END AS outcome,
  count(*) AS entries FROM w GROUP BY ALL""")
def backfill_integrity(spark, sf_dir):
    n = F.col("p_partkey")
    v = F.explode(F.array(*[F.lit(i) for i in range(1, 8)])).alias("v")
    registry = t.table(spark, sf_dir, "part").filter(n % 15 != 0).select(n, v).select(
        t.text("lib-", n).alias("name"),
        t.text(F.col("v"), ".0").alias("version"),
        t.text("sha512-", n, "-", F.col("v")).alias("integrity"),
    )
    done = p.backfill_integrity(_lock(spark, sf_dir), registry)
    return done.groupBy("file", "name", "version", "integrity", "outcome").agg(
        F.count(F.lit(1)).alias("entries")
    )


@query("""WITH lock AS (SELECT DISTINCT l_orderkey AS file, l_partkey AS n, l_linenumber AS q, l_returnflag AS f FROM lineitem),
w AS (SELECT *, n % 5 = 0 AND f <> 'R' AND q <> 7 AS wanted FROM lock)
SELECT file, count(*) FILTER (wanted AND n % 15 <> 0) AS fixed, count(*) FILTER (wanted AND n % 15 = 0) AS missing
FROM w GROUP BY 1""")
def fix_counts(spark, sf_dir):
    n = F.col("p_partkey")
    v = F.explode(F.array(*[F.lit(i) for i in range(1, 8)])).alias("v")
    registry = t.table(spark, sf_dir, "part").filter(n % 15 != 0).select(n, v).select(
        t.text("lib-", n).alias("name"),
        t.text(F.col("v"), ".0").alias("version"),
        F.lit("sha512-x").alias("integrity"),
    )
    return p.fix_counts(p.backfill_integrity(_lock(spark, sf_dir), registry))


@query("""SELECT p_partkey AS k, CASE i WHEN 0 THEN '' WHEN 1 THEN 'node_modules/a-' || p_partkey
    ELSE 'node_modules/a/node_modules/@s/b-' || p_partkey END AS key,
  CASE i WHEN 0 THEN '' WHEN 1 THEN 'a-' || p_partkey ELSE '@s/b-' || p_partkey END AS name,
  CASE WHEN i <> 0 THEN p_size || '.0' END AS version,
  CASE WHEN i = 2 THEN 'sha512-' || p_partkey END AS integrity, i = 2 AS has_integrity
FROM part, (VALUES (0), (1), (2)) v(i)""")
def lockfile_entries(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(
        F.lit('{"packages": {"": {"name": "root"}, "bad": 7, "node_modules/a-'),
        k,
        F.lit('": {"version": "'),
        "p_size",
        F.lit('.0"}, "node_modules/a/node_modules/@s/b-'),
        k,
        F.lit('": {"version": "'),
        "p_size",
        F.lit('.0", "integrity": "sha512-'),
        k,
        F.lit('"}}}'),
    )
    docs = t.table(spark, sf_dir, "part").select(k.alias("k"), text.alias("text"))
    return flatten_lockfiles(docs).drop("resolved")


@query(f"""WITH {PINS}, new AS (SELECT k, CASE WHEN k % 3 = 0 THEN npm_name ELSE 'new-' || k END AS npm_name,
  CASE WHEN k % 4 = 0 THEN base ELSE 'new-' || k END AS dir_name FROM pins)
SELECT n.npm_name, n.dir_name, CASE WHEN k % 3 = 0 THEN n.npm_name || ' is already pinned (' ||
    (SELECT pinned FROM pins p WHERE p.k = n.k) || ')' ELSE n.dir_name || ' already exists' END AS reason
FROM new n WHERE k % 3 = 0 OR k % 4 = 0""")
def collisions(spark, sf_dir):
    pins = _pins(spark, sf_dir)
    k = F.col("k")
    new = pins.select(
        F.when(k % 3 == 0, F.col("npm_name")).otherwise(t.text("new-", k)).alias("npm_name"),
        F.when(k % 4 == 0, F.col("dir_name")).otherwise(t.text("new-", k)).alias("dir_name"),
    )
    return p.collisions(new, pins, pins.select("dir_name"))


@query(f"""WITH {PINS}, req AS (SELECT k AS pos, CASE k % 3 WHEN 0 THEN npm_name WHEN 1 THEN base ELSE 'lost-' || k END AS requested FROM pins)
SELECT pos, requested, CASE WHEN pos % 3 <> 2 THEN p.npm_name END AS npm_name,
  CASE WHEN pos % 3 = 2 THEN 'unknown package ''' || requested || '''' END AS error
FROM req JOIN pins p ON p.k = pos""")
def select_targets(spark, sf_dir):
    pins = _pins(spark, sf_dir)
    k = F.col("k")
    requested = pins.select(
        k.alias("pos"),
        F.when(k % 3 == 0, F.col("npm_name"))
        .when(k % 3 == 1, F.col("dir_name"))
        .otherwise(t.text("lost-", k))
        .alias("name"),
    )
    chosen = p.select_targets(pins.select("npm_name", "dir_name", "pinned_version"), requested)
    return chosen.select("pos", "requested", "npm_name", "error")


@query(f"""WITH {PINS}
SELECT npm_name, CASE WHEN k % 5 = 0 THEN '9.9' ELSE pinned END AS pinned_version FROM pins WHERE k % 3 <> 0 OR k % 5 = 0
UNION ALL SELECT 'extra-' || k, '1.0' FROM pins WHERE k % 50 = 0""")
def merge_right(spark, sf_dir):
    pins = _pins(spark, sf_dir)
    k = F.col("k")
    left = pins.filter(k % 3 != 0).select("npm_name", "pinned_version")
    right = (
        pins.filter(k % 5 == 0)
        .select("npm_name", F.lit("9.9").alias("pinned_version"))
        .unionByName(
            pins.filter(k % 50 == 0).select(
                t.text("extra-", k).alias("npm_name"), F.lit("1.0").alias("pinned_version")
            )
        )
    )
    return merge(left, right, "npm_name")

"""Queries over caches, retention, chunks, nested pages, lists and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildgraph.operators import chunking as c
from buildgraph.operators import lookup as lk
from buildgraph.plans import tables as t
from buildgraph.plans.registry import query
from buildgraph.sources.readers import flatten_artifacts, parse_kv_lines

COMMITS = """
commits AS (SELECT o_custkey AS repo, o_orderkey AS commit, epoch_us(o_orderdate) AS tm,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)"""


def _commits(spark, sf_dir):
    return t.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("repo"),
        F.col("o_orderkey").alias("commit"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp_ltz")).alias("commit_time"),
        F.col("o_orderkey").alias("position"),
    )


@query(f"WITH {COMMITS} SELECT repo, commit FROM commits WHERE rn <= 5")
def keep_set(spark, sf_dir):
    return c.keep_set(_commits(spark, sf_dir), 5).select("repo", "commit")


@query("""SELECT o_custkey AS repo, o_orderkey AS commit FROM orders
WHERE o_orderkey % 10 = 0 OR o_orderkey % 10 IN (1, 2, 3, 4)""")
def keep_parents(spark, sf_dir):
    k = F.col("commit") % 10
    commits = _commits(spark, sf_dir).withColumns(
        {"is_head": k == 0, "parent_pos": F.when(k.between(1, 8), k - 1)}
    )
    return c.keep_set(commits, 5, "parents").select("repo", "commit")


@query(f"WITH {COMMITS} SELECT repo, commit FROM commits WHERE rn > 5")
def prune(spark, sf_dir):
    commits = _commits(spark, sf_dir)
    return lk.prune(commits, c.keep_set(commits, 5)).select("repo", "commit")


@query(f"""WITH {COMMITS}, h AS (SELECT * FROM commits WHERE rn = 1)
SELECT repo, commit, CASE WHEN commit % 5 = 0 THEN 'empty' WHEN commit % 3 = 0 THEN 'stale' ELSE 'current' END AS state,
  commit % 5 = 0 OR commit % 3 = 0 AS "create" FROM h""")
def entry_state(spark, sf_dir):
    commits, k = _commits(spark, sf_dir), F.col("commit")
    head = c.keep_set(commits, 1).select("repo", "commit", t.text("art-", k).alias("artifact"))
    entries = commits.filter(k % 5 != 0).select(
        "repo",
        "commit",
        F.when(k % 3 != 0, t.text("art-", k)).when(k % 2 == 0, "other").alias("artifact"),
    )
    return lk.entry_state(entries, head).drop("artifact")


@query(f"""WITH {COMMITS}
SELECT repo, arg_max(commit, (CASE WHEN commit % 9 = 0 THEN -9223372036854775807 ELSE tm END, commit)) AS sha,
  count(*) > 1 AS ambiguous FROM commits GROUP BY repo""")
def newest(spark, sf_dir):
    k = F.col("commit")
    candidates = _commits(spark, sf_dir).select(
        "repo",
        k.alias("sha"),
        F.when(k % 9 != 0, F.col("commit_time")).alias("commit_time"),
        k.alias("pos"),
    )
    return c.newest(candidates, ["repo"])


@query("""WITH r AS (SELECT l_orderkey AS req, l_partkey AS commit, (l_linenumber % 3)::BIGINT AS q FROM lineitem),
o AS (SELECT r.*, CASE WHEN q = 2 OR commit % 3 = 0 THEN 'miss' WHEN commit % 4 = q THEN 'hit' ELSE 'stale' END AS lv FROM r),
o2 AS (SELECT *, CASE WHEN lv = 'hit' AND commit % 9 = 1 THEN 'miss' WHEN lv = 'hit' AND commit % 7 = 0 THEN 'corrupt' ELSE lv END AS local_outcome,
  CASE WHEN q = 2 OR commit % 5 <> 0 THEN 'miss' WHEN commit % 2 = q THEN 'hit' ELSE 'stale' END AS remote_outcome FROM o)
SELECT req, commit, q, local_outcome, remote_outcome,
  CASE WHEN local_outcome = 'hit' THEN 'local' WHEN remote_outcome = 'hit' THEN 'remote'
    WHEN commit % 6 <> 0 THEN 'recomputed' ELSE 'empty' END AS origin,
  CASE WHEN local_outcome = 'hit' THEN '{"l":' || commit || '}' WHEN remote_outcome = 'hit' THEN '{"r":' || commit || '}'
    WHEN commit % 6 <> 0 THEN '{"e":' || commit || '}' ELSE '{}' END AS payload, count(*) AS n
FROM o2 GROUP BY ALL""")
def lookup_chain(spark, sf_dir):
    q, k = F.col("l_linenumber") % 3, F.col("p_partkey")
    requests = t.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("req"),
        F.col("l_partkey").alias("commit"),
        q.cast("bigint").alias("q"),
        F.when(q != 2, t.text("v", q)).alias("validator"),
    )
    part = t.table(spark, sf_dir, "part")
    local = part.filter(k % 3 != 0).select(
        k.alias("commit"),
        t.text("v", k % 4).alias("validator"),
        F.when(k % 9 == 1, F.lit(None).cast("string"))
        .when(k % 7 == 0, t.text('{"l":', k))
        .otherwise(t.text('{"l":', k, "}"))
        .alias("payload"),
    )
    remote = part.filter(k % 5 == 0).select(
        k.alias("commit"), t.text("v", k % 2).alias("validator"), t.text('{"r":', k, "}").alias("payload")
    )
    again = part.filter(k % 6 != 0).select(k.alias("commit"), t.text('{"e":', k, "}").alias("payload"))
    found = lk.lookup_chain(requests, [("local", local), ("remote", remote)], again)
    return found.groupBy(*[x for x in found.columns if x != "validator"]).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders)
SELECT k, position, position // 192 + 1 AS chunk, 'build-chunk-' || (position // 192 + 1) || '.json' AS chunk_file FROM n""")
def chunk(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate")
    return c.chunk(orders, ["o_orderdate", "k"]).drop("o_orderdate")


@query("""WITH n AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
SELECT (p - 1) // 100 + 1 AS chunk, count(*) AS steps, min(k) AS first FROM n GROUP BY 1""")
def chunk_even(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate")
    cut = c.chunk(orders, ["o_orderdate", "k"], n=100, offset="even")
    return cut.groupBy("chunk").agg(F.count(F.lit(1)).alias("steps"), F.min("k").alias("first"))


ITEM = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")


def _pages(spark, sf_dir):
    """One page per sixty orders: orders as builds, line numbers as jobs, items as artifacts.

    Arrays are ordered by key, with the part as tie-break.
    """
    item = F.struct(
        F.struct(
            t.text("drvmap-", F.col("l_returnflag"), ".json").alias("path"),
            t.text("url-", F.col("l_partkey")).alias("downloadURL"),
        ).alias("node")
    )
    li = t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").distinct()

    def ordered(key, value):
        return F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), lambda e: e["v"])

    def edges(array):
        return F.struct(array.alias("edges"))

    jobs = li.groupBy("l_orderkey", "l_linenumber").agg(
        ordered(F.struct("l_partkey", "l_returnflag"), item).alias("a")
    )
    job = F.struct(F.struct(edges(F.col("a")).alias("artifacts")).alias("node"))
    builds = jobs.groupBy("l_orderkey").agg(ordered(F.col("l_linenumber"), job).alias("j"))
    build = F.struct(
        F.struct((F.col("o_orderkey") % 97).cast("string").alias("commit"), edges(F.col("j")).alias("jobs")).alias("node")
    )
    orders = t.table(spark, sf_dir, "orders").join(builds, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    pages = orders.groupBy(F.floor(F.col("o_orderkey") / 60).alias("page_id")).agg(ordered(F.col("o_orderkey"), build).alias("b"))
    inner = F.struct(F.struct(edges(F.col("b")).alias("builds")).alias("pipeline"))
    return pages.select("page_id", F.struct(inner.getField("pipeline").alias("pipeline")).alias("d")).select(
        "page_id", F.struct(F.col("d").alias("data")).alias("page")
    )


ARTIFACTS = """
li AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS q, l_partkey AS p, l_returnflag AS f FROM lineitem),
builds AS (SELECT o_orderkey // 60 AS page_id, o_orderkey AS o, row_number() OVER (PARTITION BY o_orderkey // 60 ORDER BY o_orderkey) - 1 AS build_pos FROM orders),
flat AS (SELECT page_id, (li.o % 97)::VARCHAR AS commit, build_pos, dense_rank() OVER (PARTITION BY li.o ORDER BY q) - 1 AS job_pos,
  row_number() OVER (PARTITION BY li.o, q ORDER BY p, f) - 1 AS artifact_pos, 'drvmap-' || f || '.json' AS path, 'url-' || p AS download_url
  FROM li JOIN builds USING (o))"""


@query(f"WITH {ARTIFACTS} SELECT * FROM flat")
def artifacts(spark, sf_dir):
    flat = flatten_artifacts(_pages(spark, sf_dir))
    return flat.withColumns({x: F.col(x).cast("bigint") for x in ("build_pos", "job_pos", "artifact_pos")})


@query(f"WITH {ARTIFACTS} SELECT * FROM flat WHERE build_pos < 50")
def artifacts_first_builds(spark, sf_dir):
    """A page query that asks for the first fifty builds."""
    flat = flatten_artifacts(_pages(spark, sf_dir), max_builds=50)
    return flat.withColumns({x: F.col(x).cast("bigint") for x in ("build_pos", "job_pos", "artifact_pos")})


@query(f"""WITH {ARTIFACTS}
SELECT page_id, commit, arg_min(download_url, (build_pos, job_pos, artifact_pos)) AS download_url FROM flat
WHERE path = 'drvmap-A.json' AND commit <> '5' GROUP BY ALL""")
def first_match(spark, sf_dir):
    wanted = t.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 97).cast("string").alias("commit"))
    wanted = wanted.filter("commit <> '5'")
    flat = flatten_artifacts(_pages(spark, sf_dir), commits=wanted)
    return c.first_match(flat, wanted, "drvmap-A.json", ["page_id"])


@query("""SELECT l_partkey, arg_min(l_orderkey, (l_shipdate, l_orderkey)) AS l_orderkey, min(epoch_us(l_shipdate)) AS at
FROM lineitem GROUP BY l_partkey""")
def ordered_distinct(spark, sf_dir):
    li = t.table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_orderkey", F.unix_micros(F.col("l_shipdate").cast("timestamp_ltz")).alias("at")
    )
    return c.ordered_distinct(li, "l_partkey", ["at", "l_orderkey"])


@query("""WITH u AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '#')[1] AS x FROM pages),
l AS (SELECT page_id, 0 AS pos, split_part(x, '?', 1) AS line FROM u
  UNION ALL SELECT page_id, unnest(range(1, len(kv) + 1)), unnest(kv) FROM
    (SELECT page_id, string_split(split_part(x, '?', 2), '&') AS kv FROM u WHERE contains(x, '?'))),
s AS (SELECT page_id, pos, line, split_part(line, '=', 1) AS k, substr(line, instr(line, '=') + 1) AS v FROM l WHERE contains(line, '='))
SELECT page_id, 'target' AS key, line AS value, NULL AS error FROM l WHERE NOT contains(line, '=') AND line <> ''
UNION ALL SELECT page_id, k, v, NULL FROM s WHERE k IN ('page', 'ref')
UNION ALL SELECT page_id, k, NULL, 'unexpected line ''' || line || '''' FROM s WHERE k NOT IN ('page', 'ref')""")
def kv_configs(spark, sf_dir):
    x = F.substring_index(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "#", 1)
    pages = t.table(spark, sf_dir, "pages").select("page_id", x.alias("x"))
    has = F.contains("x", F.lit("?"))
    pairs = F.when(has, F.split(F.substring_index("x", "?", -1), "&")).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(F.substring_index("x", "?", 1)), pairs)
    rows = pages.select("page_id", F.posexplode(lines).alias("pos", "line"))
    done = parse_kv_lines(rows.withColumnRenamed("page_id", "file"), ["target", "page", "ref"])
    return done.withColumnRenamed("file", "page_id")


def _lists(spark, sf_dir):
    """Parts grouped by brand as list documents, already ending in the declared list for some."""
    k = F.col("p_partkey")
    value = (
        F.when(k % 7 == 0, t.text("/nix/store/", k))
        .when(k % 5 == 0, "npm:old")
        .otherwise(t.text("npm:p", k))
    )
    part = t.table(spark, sf_dir, "part")
    entries = part.select(
        t.text("s", F.col("p_size")).alias("doc_id"), k.alias("pos"), (k % 3 == 0).alias("is_object"), value.alias("value")
    )
    docs = entries.select("doc_id").distinct().select("doc_id", F.array(F.lit("a")).alias("skills"))
    return docs, entries


DECLARED = ("/nix/store/x", "npm:new", "/nix/store/x")

LISTS = """
e AS (SELECT 's' || p_size AS doc_id, p_partkey AS pos, p_partkey % 3 = 0 AS is_object,
  CASE WHEN p_partkey % 7 = 0 THEN '/nix/store/' || p_partkey WHEN p_partkey % 5 = 0 THEN 'npm:old'
    ELSE 'npm:p' || p_partkey END AS value FROM part)"""


@query(f"""WITH {LISTS}
SELECT doc_id, 0 AS part, pos, is_object, value FROM e WHERE is_object OR (value <> 'npm:old' AND value NOT LIKE '/nix/store/%')
UNION ALL SELECT doc_id, 1, pos, false, value FROM (SELECT DISTINCT doc_id FROM e),
  (VALUES (0, '/nix/store/x'), (1, 'npm:new')) v(pos, value)""")
def reconcile_lists(spark, sf_dir):
    docs, entries = _lists(spark, sf_dir)
    return lk.reconcile_lists(docs, entries, DECLARED, ["npm:old"])


@query("""WITH d AS (SELECT p_partkey AS k FROM part)
SELECT k AS doc_id, (CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_kept, (CASE WHEN k % 3 = 2 THEN 1 ELSE 2 END)::BIGINT AS n_dropped,
  k % 3 = 0 AS unchanged, 'a' AS skills FROM d""")
def reconciled_documents(spark, sf_dir):
    k = F.col("p_partkey")
    docs = t.table(spark, sf_dir, "part").select(k.alias("doc_id"), F.array(F.lit("a")).alias("skills"))
    first = F.when(k % 2 == 0, F.array(F.lit("npm:mine"))).otherwise(F.array().cast("array<string>"))
    a, b = F.lit("/nix/store/x"), F.lit("/nix/store/y")
    rest = F.when(k % 3 == 0, F.array(a, b)).when(k % 3 == 1, F.array(b, a)).otherwise(F.array(a))
    entries = t.table(spark, sf_dir, "part").select(
        k.alias("doc_id"), F.posexplode(F.concat(first, rest)).alias("pos", "value")
    ).withColumn("is_object", F.lit(False))
    done = lk.reconciled_documents(docs, entries, ["/nix/store/x", "/nix/store/y"], [], ["a"])
    return done.withColumn("skills", F.array_join("skills", ","))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
  regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages),
r AS (SELECT *, CASE WHEN host NOT LIKE '%.com' THEN 403 WHEN path LIKE '/en/%.html' THEN 200
  WHEN path LIKE '/en/%' THEN 302 ELSE 404 END AS status FROM u)
SELECT page_id, status, CASE WHEN status = 302 THEN 'https://example.org' || path END AS location FROM r""")
def route(spark, sf_dir):
    pages = t.table(spark, sf_dir, "pages").select("page_id", "url")
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    paths = pages.select(path.alias("path")).distinct().filter("path LIKE '/en/%'")
    html = F.col("path").endswith(".html")
    redirects = paths.filter(~html).select("path", t.text("https://example.org", F.col("path")).alias("target"))
    hosts = pages.select(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host")).distinct()
    hosts = hosts.filter("host LIKE '%.com'")
    return lk.route(pages, hosts, paths.filter(html), redirects).drop("url")

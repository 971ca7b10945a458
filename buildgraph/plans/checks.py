"""Queries over filters, audits and text extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildgraph.operators import extract as x
from buildgraph.operators import filters as f
from buildgraph.plans import tables as t
from buildgraph.plans.registry import query


def _parts(spark, sf_dir):
    k = F.col("p_partkey")
    return t.table(spark, sf_dir, "part").select(
        t.text("part/", k).alias("tree_path"),
        F.array(F.when(k % 10 == 3, "pipelines").otherwise("part"), k.cast("string")).alias("parts"),
        (k % 3 != 0).alias("has_output"),
        F.when(k % 2 == 0, k % 8 == 0).alias("broken"),
        (F.col("p_size") == 7).alias("ci_skip"),
    )


@query("""SELECT 'part/' || p_partkey AS tree_path FROM part
WHERE p_partkey % 3 <> 0 AND NOT p_partkey % 8 = 0 AND p_size <> 7 AND p_partkey % 10 <> 3
  AND p_brand <> 'Brand#7'""")
def eligible(spark, sf_dir):
    excluded = t.table(spark, sf_dir, "part").filter("p_brand = 'Brand#7'")
    excluded = excluded.select(t.text("part/", F.col("p_partkey")).alias("tree_path"))
    return f.eligible(_parts(spark, sf_dir), excluded).select("tree_path")


def _inventory(spark, sf_dir):
    """Files in a tree of brand/size/part folders, some with markers."""
    k, brand, size = F.col("p_partkey"), F.col("p_brand"), F.col("p_size")
    parts = t.table(spark, sf_dir, "part")
    leaf = F.array(F.lower(F.replace(brand, F.lit("#"), F.lit("-"))), t.text("s", size), t.text("p", k))

    def file(cond, folder, name):
        return F.when(cond, F.concat(folder, F.array(name)))

    every = F.lit(True)
    files = F.array(
        file(k % 3 != 1, leaf, F.lit("default.nix")),
        file(k % 2 == 0, leaf, F.lit("shell.nix")),
        file(every, leaf, t.text("extra", k % 4, ".nix")),
        file(every, leaf, F.lit("README.md")),
        file(k % 5 == 0, leaf, F.lit(".hidden.nix")),
        file(k % 13 == 0, leaf, F.lit(".skip-tree")),
        file(k % 17 == 0, leaf, F.lit(".skip-subtree")),
        file(k % 19 == 0, F.concat(leaf, F.array(F.lit(".cache"))), F.lit("default.nix")),
        file(k % 7 == 0, F.concat(leaf, F.array(F.lit("sub"))), F.lit("default.nix")),
        file(k % 101 == 0, F.slice(leaf, 1, 2), F.lit(".skip-tree")),
        file(k % 103 == 0, F.slice(leaf, 1, 2), F.lit(".skip-subtree")),
        file(k % 11 == 0, F.slice(leaf, 1, 1), F.lit("default.nix")),
    )
    return parts.select(F.explode(F.filter(files, lambda p: p.isNotNull())).alias("parts")).distinct()


INVENTORY = """
p AS (SELECT p_partkey AS k, replace(lower(p_brand), '#', '-') AS b, p_size AS s FROM part),
leaf AS (SELECT k, b, b || '/s' || s AS bs, b || '/s' || s || '/p' || k AS d FROM p),
files AS (
  SELECT d AS dir, 'default.nix' AS name FROM leaf WHERE k % 3 <> 1
  UNION SELECT d, 'shell.nix' FROM leaf WHERE k % 2 = 0
  UNION SELECT d, 'extra' || (k % 4) || '.nix' FROM leaf
  UNION SELECT d, '.skip-tree' FROM leaf WHERE k % 13 = 0
  UNION SELECT d, '.skip-subtree' FROM leaf WHERE k % 17 = 0
  UNION SELECT d || '/sub', 'default.nix' FROM leaf WHERE k % 7 = 0
  UNION SELECT bs, '.skip-tree' FROM leaf WHERE k % 101 = 0
  UNION SELECT bs, '.skip-subtree' FROM leaf WHERE k % 103 = 0
  UNION SELECT b, 'default.nix' FROM leaf WHERE k % 11 = 0),
dirs AS (SELECT dir, bool_or(name = 'default.nix') AS has_default, bool_or(name = '.skip-tree') AS tree,
  bool_or(name = '.skip-subtree') AS sub FROM files GROUP BY dir),
lineage AS (SELECT dir, array_to_string(string_split(dir, '/')[1:n], '/') AS above
  FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS n FROM dirs)),
dropped AS (SELECT DISTINCT l.dir FROM lineage l JOIN dirs m ON m.dir = l.above
  WHERE m.tree OR (m.sub AND l.above <> l.dir)),
visible AS (
  SELECT CASE WHEN f.name = 'default.nix' THEN f.dir ELSE f.dir || '/' || replace(f.name, '.nix', '') END AS target,
    f.dir || '/' || f.name AS file
  FROM files f JOIN dirs d ON d.dir = f.dir
  WHERE f.dir NOT IN (SELECT dir FROM dropped) AND f.name LIKE '%.nix'
    AND (f.name = 'default.nix' OR (NOT d.sub AND (NOT d.has_default OR f.name = 'shell.nix'))))"""


@query(f"WITH {INVENTORY} SELECT target, file FROM visible")
def visible_targets(spark, sf_dir):
    seen = f.visible_targets(_inventory(spark, sf_dir))
    return seen.select(F.array_join("parts", "/").alias("target"), "file")


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*|[?#].*$', '', 'g') AS path FROM pages)
SELECT page_id, path FROM u WHERE path NOT LIKE '%.html'
  AND regexp_matches(regexp_extract(path, '[^/]*$'), '^[0-9]')""")
def filter_paths(spark, sf_dir):
    paths = t.table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_replace("url", r"^[a-z]+://[^/]*|[?#].*$", "").alias("path"),
        F.lit("regular").alias("type"),
    )
    return f.filter_paths(
        paths, [f.PathRule("suffix", ".html")], [f.PathRule("match", "^[0-9]")]
    ).select("page_id", "path")


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*|[?#].*$', '', 'g') AS path FROM pages),
v AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN path || '/target' WHEN page_id % 6 = 1 THEN path || '/a.nix'
  WHEN page_id % 6 = 2 THEN path || '/result-1' WHEN page_id % 6 = 3 THEN path || '/x.swp'
  WHEN page_id % 6 = 4 THEN path || '/.swp' ELSE path || '/main.rs~' END AS path,
  CASE WHEN page_id % 2 = 0 THEN 'directory' ELSE 'regular' END AS type FROM u)
SELECT page_id, path, type FROM v WHERE page_id % 6 IN (1, 2, 3)""")
def crate_sources(spark, sf_dir):
    p = F.regexp_replace("url", r"^[a-z]+://[^/]*|[?#].*$", "")
    m = F.col("page_id") % 6
    ends = ["/target", "/a.nix", "/result-1", "/x.swp", "/.swp", "/main.rs~"]
    name = F.element_at(F.array(*[F.lit(e) for e in ends]), (m + 1).cast("int"))
    paths = t.table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(p, name).alias("path"),
        F.when(F.col("page_id") % 2 == 0, "directory").otherwise("regular").alias("type"),
    )
    return f.filter_paths(paths, **f.CRATE_SOURCES)


@query(f"""WITH {t.RESULTS} SELECT tree_path, status FROM results
WHERE NOT has_owner OR (discord IS NULL AND github IS NULL)""")
def unowned(spark, sf_dir):
    return f.unowned(t.results(spark, sf_dir)).select("tree_path", "status")


WORDS = ("tion", "Enan", "the of", "eux")


@query("""SELECT doc_id, contains(text, 'tion') OR contains(text, 'Enan') OR contains(text, 'the of')
  OR contains(text, 'eux') AS transient FROM documents""")
def classify_transient(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "text")
    return f.classify_transient(docs, "text", WORDS).select("doc_id", "transient")


@query("""WITH s AS (SELECT o_orderkey AS id,
  CASE o_orderkey % 4 WHEN 0 THEN 'build' WHEN 1 THEN 'release' WHEN 2 THEN 'deploy' ELSE 'test' END AS phase,
  CASE WHEN o_orderkey % 3 = 0 THEN 'go?' END AS prompt,
  CASE WHEN o_orderkey % 5 = 0 THEN 'rsa-' || o_orderkey ELSE 'ssh-' || o_orderkey END AS public_key,
  o_orderkey % 2 = 0 AS tailscale, CASE WHEN o_orderkey % 7 <> 0 THEN '100.64.0.1' END AS addr,
  o_orderkey % 6 = 0 AS cached, CASE WHEN o_orderkey % 18 <> 0 THEN 'http' END AS url,
  o_orderkey % 9 AS agents FROM orders)
SELECT id, 'known_phase' AS rule, 'Phase ''' || phase || ''' is not valid. Known phases: build, release' AS message
  FROM s WHERE phase NOT IN ('build', 'release')
UNION ALL SELECT id, 'no_prompt_in_build', 'a prompt can not be used by steps in the build phase'
  FROM s WHERE phase = 'build' AND prompt IS NOT NULL
UNION ALL SELECT id, 'public_key', 'invalid public key: ' || public_key FROM s WHERE public_key NOT LIKE 'ssh-%'
UNION ALL SELECT id, 'tailnet_address', 'tailscaleAddr must be set because tailscale = true'
  FROM s WHERE tailscale AND addr IS NULL
UNION ALL SELECT id, 'cache_settings', 'url and publicKey must be set when the client-side cache is enabled'
  FROM s WHERE cached AND url IS NULL
UNION ALL SELECT id, 'agent_count', 'agent count must be > 0, found 0' FROM s WHERE agents = 0""")
def check_rules(spark, sf_dir):
    k = F.col("o_orderkey")
    phase = F.element_at(
        F.array(*[F.lit(p) for p in ("build", "release", "deploy", "test")]), (k % 4 + 1).cast("int")
    )
    steps = t.table(spark, sf_dir, "orders").select(
        k.alias("id"),
        phase.alias("phase"),
        F.when(k % 3 == 0, "go?").alias("prompt"),
        F.when(k % 5 == 0, t.text("rsa-", k)).otherwise(t.text("ssh-", k)).alias("public_key"),
        (k % 2 == 0).alias("tailscale"),
        F.when(k % 7 != 0, "100.64.0.1").alias("tailscale_addr"),
        (k % 6 == 0).alias("cache_enabled"),
        F.when(k % 18 != 0, "http").alias("url"),
        (k % 9).alias("agent_count"),
    )
    rules = [
        f.known_phase(["build", "release"]),
        f.no_prompt_in_build(),
        f.public_key(),
        f.tailnet_address(),
        f.cache_settings(),
        f.agent_count(),
    ]
    return f.check_rules(steps, rules, ["id"])


@query("""SELECT l_orderkey AS from_key, l_suppkey AS to_key, count(*) AS refs FROM lineitem
WHERE l_suppkey % 5 = 0 AND l_orderkey % 5 <> 0
  AND NOT (l_orderkey % 5 = 1 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'))
GROUP BY 1, 2""")
def audit_restricted(spark, sf_dir):
    li, a, b = t.table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), F.col("l_suppkey")
    top = lambda c: t.text("top", c % 5)
    refs = li.select(
        a.alias("from_key"),
        b.alias("to_key"),
        F.array(top(a), a.cast("string")).alias("from_parts"),
        F.array(top(b), b.cast("string")).alias("to_parts"),
    )
    o = F.col("o_orderkey")
    listed = t.table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "P") & (o % 5 == 1))
    listed = listed.select(F.array(top(o), o.cast("string")).alias("parts"))
    found = f.audit_restricted(refs, "top0", listed)
    return found.groupBy("from_key", "to_key").agg(F.count(F.lit(1)).alias("refs"))


# Every third page loses its opening mark, every fifth its closing marks.
CUT_PAGES = """
cut AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(html, '<script>', '')
  WHEN page_id % 5 = 0 THEN replace(html, '</script>', '') ELSE html END AS html FROM pages)"""


def _cut_pages(spark, sf_dir):
    i, h = F.col("page_id"), F.col("html")
    html = (
        F.when(i % 3 == 0, F.replace(h, F.lit("<script>"), F.lit("")))
        .when(i % 5 == 0, F.replace(h, F.lit("</script>"), F.lit("")))
        .otherwise(h)
    )
    return t.table(spark, sf_dir, "pages").select("page_id", html.alias("html"))


@query(f"""WITH {CUT_PAGES},
rest AS (SELECT page_id, html, CASE WHEN instr(html, '<script>') > 0
  THEN substr(html, instr(html, '<script>') + 8) END AS rest FROM cut)
SELECT page_id, CASE WHEN rest IS NULL THEN 'missing_open' WHEN instr(rest, '</script>') = 0 THEN 'unterminated'
    ELSE 'ok' END AS outcome,
  CASE WHEN rest IS NULL THEN strlen(html) END AS n_bytes,
  CASE WHEN instr(rest, '</script>') > 0 THEN substr(rest, 1, instr(rest, '</script>') - 1) END AS body FROM rest""")
def extract_between(spark, sf_dir):
    return x.extract_between(_cut_pages(spark, sf_dir), "html", "<script>", "</script>").drop("html")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'missing_open' WHEN event_id % 5 = 0 THEN 'bad_json'
  ELSE 'ok' END AS outcome,
  CASE WHEN event_id % 3 = 0 THEN strlen(props) + 8 END AS n_bytes,
  CASE WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 THEN (props ->> '$.k')::BIGINT END AS k FROM events""")
def extract_json(spark, sf_dir):
    e, p = F.col("event_id"), F.col("props")
    mark = F.when(e % 3 == 0, F.lit("datum = ")).otherwise(F.lit("data == "))
    body = F.when(e % 5 == 0, F.concat(p, F.lit("}"))).otherwise(p)
    pages = t.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(e % 3 == 0, F.concat(mark, p)).otherwise(F.concat(mark, body, F.lit(";end"))).alias("html"),
    )
    found = x.extract_between(pages, "html", "data == ", ";end", "k bigint")
    return found.select("event_id", "outcome", "n_bytes", F.col("data.k").alias("k"))


@query("""WITH d AS (SELECT p_partkey AS k FROM part)
SELECT k, CASE WHEN k % 11 = 0 THEN 'no_anchor' WHEN k % 7 = 0 AND k % 5 <> 0 THEN 'no srcHash'
    WHEN k % 7 <> 0 AND k % 5 = 0 THEN 'srcHash matches 2 times' ELSE 'ok' END AS outcome,
  CASE WHEN k % 11 <> 0 THEN 'name' || k END AS pname,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 2 = 0 THEN '@scope/name' || k ELSE 'name' || k END AS npm_name,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 7 <> 0 THEN 'sha256-' || k || '='
    WHEN k % 5 = 0 THEN 'sha256-again' || k || '=' END AS src_hash FROM d""")
def extract_exactly_one(spark, sf_dir):
    k = F.col("k")
    text = F.concat(
        F.lit('# stale\n  srcHash = "sha256-OLD="\n'),
        F.when(k % 11 == 0, "mkOther {\n").otherwise("mkPackage {\n"),
        t.text('  pname = "name', k, '";\n'),
        F.when(k % 2 == 0, t.text('  npmName = "@scope/name', k, '";\n')).otherwise(""),
        F.when(k % 7 != 0, t.text('  srcHash = "sha256-', k, '=";\n')).otherwise(""),
        F.when(k % 5 == 0, t.text('  srcHash = "sha256-again', k, '=";\n')).otherwise(""),
        F.lit("}\n"),
    )
    defs = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).withColumn("text", text)
    found = x.extract_exactly_one(defs, "text", "mkPackage", ["pname", "srcHash"], {"npmName": "pname"})
    return found.select(
        "k",
        "outcome",
        "pname",
        F.col("npmName").alias("npm_name"),
        F.col("srcHash").alias("src_hash"),
    )


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'sha256-' || doc_id || '/a+b=' END AS got_hash FROM documents""")
def extract_got_hash(spark, sf_dir):
    i = F.col("doc_id")
    hint = t.text("\nspecified: sha256-AAAA=\n   got:    sha256-", i, "/a+b=\n  got: sha256-late=\n")
    logs = t.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 3 == 0, F.concat("text", hint, F.col("text"))).otherwise(F.col("text")).alias("text")
    )
    return x.extract_got_hash(logs).select("doc_id", "got_hash")

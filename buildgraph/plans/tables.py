"""The sample tables seen as snapshots, edges, logs, results, pins and so on.

Each mapping comes twice: as DataFrames, and as SQL text (common table
expressions, named in capitals) for the oracles.  They are written
independently of the operators.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildgraph.functions.text import STORE_PREFIX


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the sample tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts) -> Column:
    """Concatenation of columns and literals as text."""
    return F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])


# --- target snapshots -----------------------------------------------------

#: Parent targets shipped before this day, current ones from it on; together they are all items.
CUT_DAY = "1998-07-01"


def _system(size):
    return (
        F.when(size % 4 == 0, "x86_64-linux")
        .when(size % 4 == 1, "aarch64-linux")
        .when(size % 4 == 2, "aarch64-darwin")
    )


def _attr_type(t):
    return (
        F.when(t == "ECONOMY", "nixos-system")
        .when(t == "MEDIUM", "darwin-system")
        .when(t == "LARGE", "home-manager-system")
        .when(t == "PROMO", "formatting-check")
        .when(t == "SMALL", "shell")
    )


def snapshot(spark: SparkSession, sf_dir: str, current: bool) -> DataFrame:
    """Targets of one side of the cut day: parts by line number."""
    shipped = F.col("l_shipdate") >= F.expr(f"timestamp_ntz'{CUT_DAY}'")
    ships = table(spark, sf_dir, "lineitem").filter(shipped if current else ~shipped)
    drvs = ships.groupBy((F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("k")).agg(
        F.concat(F.count(F.lit(1)), F.lit("-"), F.max("l_orderkey") % 3).alias("drv_path")
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    k = F.col("k")
    return drvs.join(part, F.col("p_partkey") == F.expr("k div 10"), "left").select(
        F.lit("current" if current else "parent").alias("snapshot_id"),
        text("part/", k).alias("tree_path"),
        "drv_path",
        F.array(F.lit("part"), k.cast("string")).alias("attr_path"),
        _system(F.col("p_size")).alias("system"),
        _attr_type(F.col("p_type")).alias("dev_attr_type"),
        F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("out"), text(STORE_PREFIX, k, "-out")))
        .otherwise(
            F.create_map(
                F.lit("out"),
                text(STORE_PREFIX, k, "-out"),
                F.lit("dev"),
                text(STORE_PREFIX, k, "-dev"),
            )
        )
        .alias("outputs"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parent and current snapshot."""
    return snapshot(spark, sf_dir, False), snapshot(spark, sf_dir, True)


def _snap_sql(name: str, side: str) -> str:
    return f"""
{name} AS (
  SELECT 'part/' || k AS tree_path, k, p_size, drv_path,
    CASE p_size % 4 WHEN 0 THEN 'x86_64-linux' WHEN 1 THEN 'aarch64-linux'
      WHEN 2 THEN 'aarch64-darwin' END AS system,
    CASE p_type WHEN 'ECONOMY' THEN 'nixos-system' WHEN 'MEDIUM' THEN 'darwin-system'
      WHEN 'LARGE' THEN 'home-manager-system' WHEN 'PROMO' THEN 'formatting-check'
      WHEN 'SMALL' THEN 'shell' END AS dev_attr_type
  FROM (SELECT l_partkey * 10 + l_linenumber AS k, count(*) || '-' || (max(l_orderkey) % 3) AS drv_path
        FROM lineitem WHERE l_shipdate {side} TIMESTAMP '{CUT_DAY}'
        GROUP BY 1) d LEFT JOIN part ON p_partkey = k // 10)"""


SNAPSHOTS = _snap_sql("parent", "<") + "," + _snap_sql("current", ">=")

DIFF = (
    SNAPSHOTS
    + """,
diff AS (
  SELECT coalesce(c.tree_path, p.tree_path) AS tree_path,
    CASE WHEN p.tree_path IS NULL THEN 'added' WHEN c.tree_path IS NULL THEN 'removed'
      WHEN p.drv_path = c.drv_path THEN 'unchanged' ELSE 'changed' END AS change,
    coalesce(c.drv_path, p.drv_path) AS drv_path,
    CASE WHEN c.tree_path IS NULL THEN p.system ELSE c.system END AS system,
    CASE WHEN c.tree_path IS NULL THEN p.dev_attr_type ELSE c.dev_attr_type END AS dev_attr_type,
    p.drv_path AS parent_drv_path
  FROM parent p FULL JOIN current c ON p.tree_path = c.tree_path)"""
)

# --- dependency graph -----------------------------------------------------


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, part, customer, supplier, nation and region nodes and their dependencies."""
    li = table(spark, sf_dir, "lineitem")
    od = table(spark, sf_dir, "orders")
    cu = table(spark, sf_dir, "customer")
    su = table(spark, sf_dir, "supplier")
    na = table(spark, sf_dir, "nation")

    def pairs(df, a, ca, b, cb):
        return df.select(text(a, F.col(ca)).alias("src"), text(b, F.col(cb)).alias("dst"))

    every = [
        pairs(li, "o", "l_orderkey", "p", "l_partkey"),
        pairs(od, "o", "o_orderkey", "c", "o_custkey"),
        pairs(li, "p", "l_partkey", "s", "l_suppkey"),
        pairs(su, "s", "s_suppkey", "n", "s_nationkey"),
        pairs(cu, "c", "c_custkey", "n", "c_nationkey"),
        pairs(na, "n", "n_nationkey", "r", "n_regionkey"),
    ]
    return reduce(DataFrame.unionByName, every)


def nodes(edge_rows: DataFrame) -> DataFrame:
    """Nodes of the graph; orders, suppliers and regions are known."""
    ids = edge_rows.select(F.col("src").alias("id")).unionByName(
        edge_rows.select(F.col("dst").alias("id"))
    )
    return ids.distinct().withColumn("known", F.substring("id", 1, 1).isin("o", "s", "r"))


EDGES = """
edges AS (
  SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem
  UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders
  UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deep graph with a cycle: part k needs k div 2 and k div 3, part 1 the last part."""
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    down = [
        keys.filter("k > 0").select(
            text("p", F.col("k")).alias("src"), text("p", F.floor(F.col("k") / n)).alias("dst")
        )
        for n in (2, 3)
    ]
    back = keys.agg(F.max("k").alias("k")).select(
        F.lit("p1").alias("src"), text("p", F.col("k")).alias("dst")
    )
    return down[0].unionByName(down[1]).unionByName(back).distinct()


LADDER = """
ladder AS (
  SELECT 'p' || p_partkey AS src, 'p' || (p_partkey // 2) AS dst FROM part WHERE p_partkey > 0
  UNION SELECT 'p' || p_partkey, 'p' || (p_partkey // 3) FROM part WHERE p_partkey > 0
  UNION SELECT 'p1', 'p' || max(p_partkey) FROM part)"""

# --- build log ------------------------------------------------------------


def log_of(events: DataFrame) -> DataFrame:
    """Events seen as build-log records of one run."""
    kind, e = F.col("event_type"), F.col("event_id")
    action = F.when(kind == "view", "start").when(kind == "signup", "msg").otherwise("result")
    line = F.when(e % 10 == 0, text("curl error ", e)).otherwise(text("line ", e))
    return events.select(
        F.lit("r0").alias("run"),
        e.alias("seq"),
        action.alias("action"),
        F.col("user_id").alias("id"),
        F.when(kind == "click", 101)
        .when(kind.isin("error", "purchase"), 0)
        .cast("bigint")
        .alias("type"),
        F.when(kind == "view", text("d", F.col("user_id"), "-", e))
        .when(kind == "click", line)
        .alias("arg_text"),
        F.when(kind == "error", 1 + e % 3).when(kind == "purchase", 0).cast("bigint").alias(
            "arg_int"
        ),
        F.unix_micros(F.col("ts").cast("timestamp_ltz")).alias("ts_us"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build log of the events table."""
    return log_of(table(spark, sf_dir, "events"))


def log_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of the log: every start but those of event ids divisible by ten."""
    starts = table(spark, sf_dir, "events").filter(
        (F.col("event_type") == "view") & (F.col("event_id") % 10 != 0)
    )
    u, e = F.col("user_id"), F.col("event_id")
    return starts.select(
        text("pkg/", u, "/", e % 5).alias("tree_path"),
        text("d", u, "-", e).alias("drv_path"),
        F.when(u % 3 == 0, "x86_64-linux").when(u % 3 == 1, "aarch64-linux").alias("system"),
    )


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked tree paths: those of the log, and one idle target per customer."""
    idle = table(spark, sf_dir, "customer").select(
        text("idle/", F.col("c_custkey")).alias("tree_path"),
        text("x", F.col("c_custkey")).alias("drv_path"),
    )
    logged = log_targets(spark, sf_dir).groupBy("tree_path").agg(F.min("drv_path").alias("drv_path"))
    return logged.unionByName(idle)


def tracked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idle target c needs a logged target and, beyond the first hundred, idle c div 2."""
    c = F.col("c_custkey")
    cust = table(spark, sf_dir, "customer")
    one = cust.filter(c < 100).select(
        text("idle/", c).alias("src"), text("pkg/", c, "/", c % 5).alias("dst")
    )
    two = cust.filter(c >= 100).select(
        text("idle/", c).alias("src"), text("idle/", F.floor(c / 2)).alias("dst")
    )
    return one.unionByName(two)


LOG = """
log AS (
  SELECT event_id AS seq, user_id AS id, event_type AS kind, epoch_us(ts) AS ts_us,
    CASE WHEN event_type = 'view' THEN 'd' || user_id || '-' || event_id END AS sdrv,
    CASE WHEN event_id % 10 = 0 THEN 'curl error ' || event_id ELSE 'line ' || event_id END AS line,
    CASE event_type WHEN 'error' THEN 1 + event_id % 3 WHEN 'purchase' THEN 0 END AS code
  FROM events),
targets AS (
  SELECT 'pkg/' || user_id || '/' || (event_id % 5) AS tree_path, 'd' || user_id || '-' || event_id AS drv_path,
    CASE user_id % 3 WHEN 0 THEN 'x86_64-linux' WHEN 1 THEN 'aarch64-linux' ELSE '' END AS system
  FROM events WHERE event_type = 'view' AND event_id % 10 <> 0),
bound AS (
  SELECT *, last_value(sdrv IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS drv FROM log),
attributed AS (
  SELECT seq, ts_us,
    CASE WHEN kind = 'click' THEN coalesce(t.tree_path, 'build') ELSE coalesce(t.tree_path, drv) END AS tree_path,
    drv AS drv_path,
    CASE WHEN kind <> 'click' THEN coalesce(t.system, 'unknown') END AS system,
    CASE kind WHEN 'view' THEN 'started' WHEN 'click' THEN 'line'
      WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status,
    code AS exit_code,
    CASE WHEN kind = 'click' THEN line END AS line
  FROM bound LEFT JOIN targets t ON t.drv_path = drv
  WHERE kind <> 'signup' AND (kind = 'click' OR drv IS NOT NULL)),
tracked AS (
  SELECT tree_path, min(drv_path) AS drv_path FROM targets GROUP BY tree_path
  UNION ALL SELECT 'idle/' || c_custkey, 'x' || c_custkey FROM customer),
tedges AS (
  SELECT 'idle/' || c_custkey AS src, 'pkg/' || c_custkey || '/' || (c_custkey % 5) AS dst
  FROM customer WHERE c_custkey < 100
  UNION ALL SELECT 'idle/' || c_custkey, 'idle/' || (c_custkey // 2) FROM customer WHERE c_custkey >= 100),
last_event AS (
  SELECT tree_path,
    arg_max(CASE status WHEN 'started' THEN 'building' ELSE status END, seq) AS state,
    arg_max(exit_code, seq) FILTER (status = 'failed') AS exit_code
  FROM attributed WHERE status <> 'line' GROUP BY tree_path),
states AS (
  SELECT t.tree_path, t.drv_path, coalesce(l.state, 'pending') AS state, l.exit_code
  FROM tracked t LEFT JOIN last_event l ON l.tree_path = t.tree_path)"""

# --- results --------------------------------------------------------------

OWNER_TYPE = "array<struct<discord: string, github: string>>"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results of targets, owned by their customers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    status = (
        F.when(F.col("o_orderstatus") == "F", "failed")
        .when(F.col("o_orderstatus") == "O", "succeeded")
        .otherwise("skipped")
    )
    owner = F.struct(
        F.when(cust % 2 == 0, F.base64(cust.cast("string").cast("binary"))).alias("discord"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("github"),
    )
    return o.join(c, cust == F.col("c_custkey"), "left").select(
        text("order/", k).alias("tree_path"),
        text("/nix/store/", F.lpad(k.cast("string"), 32, "0"), "-order").alias("drv_path"),
        F.col("o_orderpriority").alias("system"),
        status.alias("status"),
        F.when(F.col("o_orderstatus") == "F", k % 4).cast("bigint").alias("exit_code"),
        (k % 1000 * 100 + 20).cast("bigint").alias("duration_ms"),
        F.when(k % 7 == 0, F.array().cast(OWNER_TYPE)).otherwise(F.array(owner)).alias("owners"),
        F.when(F.col("o_orderstatus") == "F", text("tail ", k)).alias("log_tail"),
        _attr_type(F.element_at(F.array(*[F.lit(x) for x in ATTR_TYPES]), (k % 6 + 1).cast("int"))).alias(
            "dev_attr_type"
        ),
    )


ATTR_TYPES = ("ECONOMY", "MEDIUM", "LARGE", "PROMO", "SMALL", "STANDARD")

RESULTS = """
results AS (
  SELECT 'order/' || o_orderkey AS tree_path, o_orderkey AS k, o_orderpriority AS system,
    CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'skipped' END AS status,
    CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 4 END AS exit_code,
    o_orderkey % 1000 * 100 + 20 AS duration_ms,
    o_orderkey % 7 <> 0 AS has_owner,
    CASE WHEN o_custkey % 2 = 0 THEN to_base64(encode(o_custkey::VARCHAR)) END AS discord,
    CASE WHEN o_custkey % 2 = 0 THEN o_custkey::VARCHAR END AS discord_id,
    CASE WHEN c_acctbal >= 0 THEN c_name END AS github,
    CASE WHEN o_orderstatus = 'F' THEN 'tail ' || o_orderkey END AS log_tail,
    CASE o_orderkey % 6 WHEN 0 THEN ':nix:' WHEN 1 THEN ':mac:' WHEN 2 THEN ':house_with_garden:'
      WHEN 3 THEN ':mag:' WHEN 4 THEN ':shell:' ELSE ':package:' END AS badge
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""


# --- words ----------------------------------------------------------------


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents: runs of letters of any script, lower case."""
    docs = table(spark, sf_dir, "documents")
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("word"))


WORDS = """
words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word
  FROM documents)"""

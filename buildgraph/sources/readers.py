"""File readers.  Each returns a lazy DataFrame."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from buildgraph.functions.text import valid_json
from buildgraph.operators.extract import extract_exactly_one
from buildgraph.sources import schemas
from buildgraph.sources.json_members import SPLIT_BYTES, read_members
from buildgraph.sources.log_stream import stream_lines

LOG_PREFIX = "@nix "
#: Marker behind a log record; see :func:`parse_log_lines`.
END = "@end@"
MODES = ("failfast", "quarantine")


def _parse_struct(ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")


def _documents(spark: SparkSession, path: str | list[str], bundled: bool = False) -> DataFrame:
    """(file, text) of the files below ``path``, or of bundles as ``write_bundle`` makes them."""
    if bundled:
        return spark.read.schema("file string, text string").parquet(path)
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")
    )


def _parsed(df: DataFrame, schema: str, mode: str) -> DataFrame:
    """Add ``doc`` parsed from ``text``; malformed documents raise or are kept with a null ``doc``."""
    if mode == "failfast":
        checked = F.when(
            ~valid_json("text"),
            F.raise_error(F.concat(F.lit("malformed document: "), F.col("file"))).cast("string"),
        ).otherwise(F.col("text"))
        return df.withColumn("doc", F.from_json(checked, schema))
    return df.withColumn(
        "doc", F.when(valid_json("text"), F.from_json("text", schema))
    )


def read_snapshots(
    spark: SparkSession,
    path: str | list[str],
    mode: str = "failfast",
    quarantined: bool = False,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Snapshot documents below ``path``, one row per target, read by byte ranges of ``split_bytes``.

    A document may be of any size: it is never one value, and all its ranges are read at once.  Otherwise as
    :func:`parse_snapshots`; ``quarantined=True`` returns the broken files with null as their text.
    """
    _check_mode(mode)
    rows = read_members(spark, path, split_bytes)
    broken = rows.filter("bad").select("file").distinct()
    if quarantined:
        return broken.select("file", F.lit(None).cast("string").alias("text"))
    if mode == "failfast":
        message = F.concat(F.lit("malformed document: "), F.col("file"))
        rows = rows.withColumn("key", F.when(F.col("bad"), F.raise_error(message).cast("string")).otherwise(F.col("key")))
    else:
        rows = rows.join(broken, "file", "left_anti")
    # Of repeated keys the last counts.
    last = rows.groupBy("file", "key").agg(F.max_by("value", "at").alias("value"))
    return _targets(last.select(snapshot_name(), F.col("key").alias("tree_path"), F.from_json("value", schemas.TARGET).alias("t")))


def snapshot_name() -> Column:
    return F.regexp_extract("file", r"([^/]+?)(\.json)?$", 1).alias("snapshot_id")


def parse_snapshots(
    documents: DataFrame, mode: str = "failfast", quarantined: bool = False
) -> DataFrame:
    """Snapshot texts (``file``, ``text``: tree path to target), one row per target.

    ``snapshot_id`` is the file name without ``.json``.  A document that is not
    valid JSON raises with ``mode='failfast'``; with ``quarantine`` it yields
    no targets, and ``quarantined=True`` returns those documents instead.  Of
    repeated keys in a document the last counts.
    """
    _check_mode(mode)
    docs = _parsed(documents, f"map<string, {schemas.TARGET}>", mode)
    if quarantined:
        return docs.filter(F.col("doc").isNull()).select("file", "text")
    return _targets(docs.select(snapshot_name(), F.explode("doc").alias("tree_path", "t")))


def _targets(members: DataFrame) -> DataFrame:
    """Targets (snapshot_id, tree_path, t) as flat rows."""
    return members.select(
        "snapshot_id",
        "tree_path",
        F.col("t.drvPath").alias("drv_path"),
        F.coalesce("t.attrPath", F.array().cast("array<string>")).alias("attr_path"),
        F.col("t.system").alias("system"),
        F.col("t.devAttrType").alias("dev_attr_type"),
        F.coalesce("t.owners", F.array().cast(schemas.OWNERS)).alias("owners"),
        F.coalesce("t.deps", F.array().cast("array<string>")).alias("deps"),
        F.coalesce("t.outputs", F.create_map().cast("map<string,string>")).alias("outputs"),
    )


def status_or_unknown(status: Column) -> Column:
    """One of the three reported states, or ``unknown``."""
    return F.when(status.isin("succeeded", "failed", "skipped"), status).otherwise("unknown")


def read_results(spark: SparkSession, path: str, pattern: str = "results-*.json") -> DataFrame:
    """Results documents below folder ``path``, one row per target; none is not an error."""
    raw = (
        spark.read.schema(schemas.RESULTS)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .json(path)
    )
    return raw.select(
        "system", "branch", "commit", "success", F.explode("targets").alias("t")
    ).select(
        "system",
        "branch",
        "commit",
        "success",
        F.col("t.tree_path").alias("tree_path"),
        F.col("t.drv_path").alias("drv_path"),
        F.col("t.dev_attr_type").alias("dev_attr_type"),
        status_or_unknown(F.col("t.status")).alias("status"),
        F.col("t.duration_ms").alias("duration_ms"),
        F.col("t.exit_code").alias("exit_code"),
        F.coalesce("t.owners", F.array().cast(schemas.OWNERS)).alias("owners"),
        F.col("t.log_tail").alias("log_tail"),
    )


def read_result_rows(spark: SparkSession, path: str) -> DataFrame:
    """Target rows written by ``write_results``."""
    return (
        spark.read.schema(schemas.RESULT_ROW)
        .option("mode", "FAILFAST")
        .json(f"{path}/targets")
        .withColumn("status", status_or_unknown(F.col("status")))
    )


def first_text(fields: str | Column) -> Column:
    """First log field when it is a string, else null."""
    f = F.col(fields) if isinstance(fields, str) else fields
    first = F.get(f, F.lit(0))
    return F.when(
        F.schema_of_variant(first) == "STRING", F.try_variant_get(first, "$", "string")
    )


def first_int(fields: str | Column) -> Column:
    """First log field when it is an integer number, else null; numeric text does not count."""
    f = F.col(fields) if isinstance(fields, str) else fields
    first = F.get(f, F.lit(0))
    return F.when(
        F.schema_of_variant(first) == "BIGINT", F.try_variant_get(first, "$", "bigint")
    )


def parse_log_lines(lines: DataFrame, mode: str = "failfast", text_col: str = "value") -> DataFrame:
    """Structured log records from raw lines.

    Only lines with the log prefix count.  Records without an action are
    dropped.  A malformed record raises (``failfast``) or is dropped; see
    :func:`malformed_log_lines`.  ``arg_text`` / ``arg_int`` hold the first
    field, by its JSON type.  Other columns of ``lines`` are kept.
    """
    _check_mode(mode)
    keep = [c for c in lines.columns if c != text_col]
    # Null without the prefix: filters may be evaluated in any order, so the
    # malformed check must not depend on the prefix filter running first.
    prefixed = F.startswith(F.col(text_col), F.lit(LOG_PREFIX))
    body = F.when(prefixed, F.substring(F.col(text_col), len(LOG_PREFIX) + 1, 1 << 30))
    marked = lines.filter(prefixed).select(*keep, body.alias("_json"))
    # With a marker behind it, one parse tells whether the record is the whole line.  Lines that
    # fail this, or hold the marker themselves, are judged and parsed on their own.
    fields = [f.name for f in _parse_struct(schemas.LOG_LINE)]
    marked = marked.select(
        *keep,
        "_json",
        F.from_json(
            F.concat(F.lit("["), "_json", F.lit(f',{{"{END}":1}}]')),
            f"array<struct<{schemas.LOG_LINE}, `{END}`: int>>",
        ).alias("_pair"),
    )
    whole = (
        (F.size("_pair") == 2)
        & (F.try_element_at("_pair", F.lit(2))[END] == 1)
        & ~F.contains("_json", F.lit(END))
    )
    first = F.get("_pair", F.lit(0))
    bad = F.col("_json").isNotNull() & ~valid_json("_json")
    if mode == "failfast":
        checked = F.when(
            bad, F.raise_error(F.concat(F.lit("malformed log line: "), F.col("_json")))
        ).otherwise(F.col("_json"))
    else:
        checked = F.when(~bad, F.col("_json"))
    record = F.when(
        F.coalesce(whole, F.lit(False)), F.struct(*[first[f].alias(f) for f in fields])
    ).otherwise(F.from_json(checked, schemas.LOG_LINE))
    # A generator between: the filter on the action must not repeat the parse.
    parsed = marked.select(*keep, F.explode(F.array(record)).alias("l"))
    return parsed.filter(F.col("l.action").isNotNull()).select(
        *keep,
        "l.action",
        "l.id",
        "l.level",
        "l.parent",
        "l.type",
        "l.text",
        "l.msg",
        F.col("l.rawMsg").alias("raw_msg"),
        first_text(F.col("l.fields")).alias("arg_text"),
        first_int(F.col("l.fields")).alias("arg_int"),
    )


def malformed_log_lines(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Prefixed lines whose JSON does not parse."""
    body = F.substring(F.col(text_col), len(LOG_PREFIX) + 1, 1 << 30)
    return lines.filter(
        F.startswith(F.col(text_col), F.lit(LOG_PREFIX)) & ~valid_json(body)
    )


def _bytes(size: str) -> int:
    """Bytes of a Spark size setting such as ``4194304``, ``128m`` or ``1gb``."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << (10 * " kmgtp".index(unit or " "))


def line_position(spark: SparkSession, block: Column | None = None) -> Column:
    """Position of a text line inside its file: unique per file and increasing, not dense.

    Splits start at least ``step`` bytes apart, so the split number and the
    row index inside the task order the lines of a file.
    """

    sizes = [
        _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")),
        _bytes(spark.conf.get("spark.sql.files.openCostInBytes")),
    ]
    step = max(1, min(sizes))
    start = F.col("_metadata.file_block_start") if block is None else block
    split = F.floor(start / F.lit(step))
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return (F.shiftleft(split, 33) + index).cast("bigint")


def read_build_log(
    spark: SparkSession, path: str, streaming: bool = False, mode: str = "failfast", complete: bool = False
) -> DataFrame:
    """Build log records below ``path``, with ``run`` (the file) and ``seq`` (the place of the line in it).

    A streaming read follows files as they grow; a line counts when its break is written, or, with ``complete``,
    when the file ends.
    """
    if streaming:
        return parse_log_lines(stream_lines(spark, path, complete), mode)
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("run"), line_position(spark).alias("seq")
    )
    return parse_log_lines(lines, mode)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of package name to version, one row per name."""
    docs = _parsed(_documents(spark, path), "map<string,string>", "failfast")
    return docs.select(F.explode("doc").alias("npm_name", "pinned_version"))


def read_pins(
    spark: SparkSession,
    versions_path: str,
    defs_path: str,
    anchor: str,
    attrs: Sequence[str] = ("pname", "srcHash", "npmDepsHash"),
    bundled: bool = False,
) -> DataFrame:
    """Package pins: parsed definition files (``bundled`` or not) joined with their pinned versions.

    Definitions without the anchor and names without a pin are left out; an
    ambiguous definition raises.
    """
    defs = _documents(spark, defs_path, bundled)
    parsed = extract_exactly_one(defs, "text", anchor, attrs, optional={"npmName": "pname"})
    parsed = parsed.filter(F.col("outcome") != "no_anchor").withColumn(
        "pname",
        F.when(F.col("outcome").isin("ok", "no_anchor"), F.col("pname")).otherwise(
            F.raise_error(F.concat("file", F.lit(": "), "outcome")).cast("string")
        ),
    )
    named = parsed.select(
        F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("dir_name"),
        "pname",
        F.col("npmName").alias("npm_name"),
        F.col("srcHash").alias("src_hash"),
        F.col("npmDepsHash").alias("npm_deps_hash"),
    )
    return named.join(read_versions(spark, versions_path), "npm_name").orderBy("dir_name")


def flatten_artifacts(
    pages: DataFrame,
    page_col: str = "page",
    max_builds: int | None = None,
    commits: DataFrame | None = None,
) -> DataFrame:
    """Nested API pages (builds, jobs, artifacts) as one row per artifact.

    ``build_pos``, ``job_pos`` and ``artifact_pos`` keep document order.  All
    builds of a page are looked at; ``max_builds`` is the limit of a page query that
    asks for fewer.  With ``commits`` only builds of these are opened.  A build without the expected nesting contributes
    nothing; the search goes on behind it.
    """
    keep = [c for c in pages.columns if c != page_col]
    builds = pages.select(
        *keep, F.posexplode(F.col(f"{page_col}.data.pipeline.builds.edges")).alias("build_pos", "b")
    )
    if max_builds is not None:
        builds = builds.filter(F.col("build_pos") < max_builds)
    if commits is not None:
        asked = commits.select(F.col("commit").alias("_commit")).distinct()
        builds = builds.join(asked, F.col("b.node.commit") == F.col("_commit"), "left_semi")
    jobs = builds.select(
        *keep,
        "build_pos",
        F.col("b.node.commit").alias("commit"),
        F.posexplode("b.node.jobs.edges").alias("job_pos", "j"),
    )
    artifacts = jobs.select(
        *keep,
        "build_pos",
        "commit",
        "job_pos",
        F.posexplode("j.node.artifacts.edges").alias("artifact_pos", "a"),
    )
    return artifacts.select(
        *keep,
        "commit",
        "build_pos",
        "job_pos",
        "artifact_pos",
        F.col("a.node.path").alias("path"),
        F.col("a.node.downloadURL").alias("download_url"),
    )


def read_api_pages(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """API page documents, ``bundled`` or one per file, as ``file`` and a parsed ``page``; a page with errors has null data."""
    return (
        _documents(spark, path, bundled)
        .withColumn("page", F.from_json("text", schemas.API_PAGE))
        .select("file", "page")
    )


def flatten_lockfiles(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Lockfile texts as one row per object entry of ``packages``; other entries are skipped.

    ``has_integrity`` tells a present (even empty) value from a missing one.
    """
    keep = [c for c in docs.columns if c != text_col]
    raw = docs.select(
        *keep,
        F.explode(F.from_json(text_col, "packages map<string, variant>").getField("packages")).alias(
            "key", "v"
        ),
    ).filter(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))

    def text(name: str) -> Column:
        value = F.try_variant_get("v", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value) != "VOID", F.try_variant_get("v", f"$.{name}", "string"))

    return raw.select(
        *keep,
        "key",
        F.substring_index("key", "node_modules/", -1).alias("name"),
        text("version").alias("version"),
        text("resolved").alias("resolved"),
        text("integrity").alias("integrity"),
        F.try_variant_get("v", "$.integrity", "variant").isNotNull().alias("has_integrity"),
    )


def read_lockfiles(spark: SparkSession, path: str) -> DataFrame:
    """Lockfiles below ``path``, one row per package entry."""
    return flatten_lockfiles(_documents(spark, path))


def parse_kv_lines(
    lines: DataFrame, allowed: Sequence[str] = ("root", "target"), bare_key: str = "target"
) -> DataFrame:
    """Settings per file from (file, pos, line) rows.

    Lines are trimmed; blank lines and ``#`` comments are skipped.  ``key=value``
    is split at the first ``=``; of repeated keys the last line counts.  A line
    without ``=`` sets ``bare_key`` only if nothing set it before, so the first
    bare line counts unless any keyed line does.  A key that is not allowed
    gives an error row (``error`` set) beside the others.
    """
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    cleaned = lines.select("file", "pos", text.alias("line")).filter(
        (F.col("line") != "") & ~F.startswith("line", F.lit("#"))
    )
    at = F.instr("line", "=")
    strip = r"^\s+|\s+$"
    split = cleaned.select(
        "file",
        "pos",
        "line",
        (at == 0).alias("bare"),
        F.when(at == 0, F.lit(bare_key))
        .otherwise(F.regexp_replace(F.substring("line", F.lit(1), at - 1), strip, ""))
        .alias("key"),
        F.when(at == 0, F.col("line"))
        .otherwise(
            F.regexp_replace(F.substring(F.col("line"), at + 1, F.length("line")), strip, "")
        )
        .alias("value"),
    )
    good = F.col("bare") | F.col("key").isin(*allowed)
    settings = (
        split.filter(good)
        .groupBy("file", "key")
        .agg(
            F.max_by("value", F.when(~F.col("bare"), F.col("pos"))).alias("_keyed"),
            F.min_by("value", F.when(F.col("bare"), F.col("pos"))).alias("_bare"),
        )
        .select(
            "file",
            "key",
            F.coalesce("_keyed", "_bare").alias("value"),
            F.lit(None).cast("string").alias("error"),
        )
    )
    errors = split.filter(~good).select(
        "file",
        "key",
        F.lit(None).cast("string").alias("value"),
        F.concat(F.lit("unexpected line '"), "line", F.lit("'")).alias("error"),
    )
    return settings.unionByName(errors)


def read_kv_configs(
    spark: SparkSession, path: str, allowed: Sequence[str] = ("root", "target"), bundled: bool = False
) -> DataFrame:
    """Key=value files below ``path``, ``bundled`` or not; see :func:`parse_kv_lines`."""
    if bundled:
        docs = _documents(spark, path, bundled)
        return parse_kv_lines(docs.select("file", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("pos", "line")), allowed)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        line_position(spark).alias("pos"),
        F.col("value").alias("line"),
    )
    return parse_kv_lines(lines, allowed)

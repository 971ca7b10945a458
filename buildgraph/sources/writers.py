"""Sinks for snapshots and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildgraph.operators.state import all_succeeded


def write_snapshot(snapshot: DataFrame, changed: DataFrame, path: str, mode: str = "error") -> None:
    """Write the full snapshot and its changed-only subset as Parquet, one folder per snapshot."""
    snapshot.write.mode(mode).partitionBy("snapshot_id").parquet(f"{path}/full")
    changed.write.mode(mode).partitionBy("snapshot_id").parquet(f"{path}/changed")


def snapshot_json(snapshot: DataFrame) -> DataFrame:
    """Snapshot rows as JSON members, one (snapshot_id, tree_path, json) row per target.

    The members of a snapshot joined by commas inside braces are its document;
    they stay separate rows so that no snapshot has to fit into one value.
    """
    body = F.to_json(
        F.struct(
            F.col("drv_path").alias("drvPath"),
            F.col("attr_path").alias("attrPath"),
            "system",
            F.col("dev_attr_type").alias("devAttrType"),
            "owners",
            "deps",
            "outputs",
        )
    )
    return snapshot.select("snapshot_id", "tree_path", body.alias("json"))


def write_bundle(docs: DataFrame, path: str) -> None:
    """Write very many small documents (file, text) into few files; readers take them with ``bundled``.

    A folder per document costs the driver and the file system far more than the document.
    Rows of one file are its lines, as in a text file.
    """
    text = F.array_join(F.collect_list(F.coalesce("text", F.lit(""))), "\n")
    docs.groupBy("file").agg(F.concat(text, F.lit("\n")).alias("text")).write.parquet(path)


def write_results(
    results: DataFrame,
    path: str,
    mode: str = "error",
    branch: str | None = None,
    commit: str | None = None,
) -> None:
    """Write target results as JSON lines, one folder per system, and a document head per system.

    ``targets/`` holds the rows with their system as data, so that an empty and a missing system
    stay apart; the folder name is an encoding of it.  ``summary/`` holds
    (system, branch, commit, success), made from the written rows.
    """
    folder = F.coalesce(F.concat(F.lit("s-"), F.url_encode("system")), F.lit("none"))
    rows = results.withColumns({"branch": F.lit(branch).cast("string"), "commit": F.lit(commit).cast("string")})
    rows.withColumn("folder", folder).write.mode(mode).partitionBy("folder").json(f"{path}/targets")
    written = results.sparkSession.read.schema(results.select("system", "status").schema).json(f"{path}/targets")
    head = all_succeeded(written, ["system"]).withColumns(
        {"branch": F.lit(branch).cast("string"), "commit": F.lit(commit).cast("string")}
    )
    head.write.mode(mode).json(f"{path}/summary")


def results_json(results: DataFrame, branch: str, commit: str) -> DataFrame:
    """Results documents as text, one (system, json) row per system, as ``read_results`` takes them.

    A document is one value, so this is for exports that fit; the rows of ``write_results``
    have no such bound.
    """
    names = ["tree_path", "drv_path", "dev_attr_type", "status", "duration_ms", "exit_code", "owners", "log_tail"]
    per = results.groupBy("system").agg(
        F.bool_and(F.coalesce(F.col("status") == "succeeded", F.lit(False))).alias("success"),
        F.sort_array(F.collect_list(F.struct(*names))).alias("targets"),
    )
    head = {"branch": F.lit(branch), "commit": F.lit(commit)}
    return per.withColumns(head).select(
        "system", F.to_json(F.struct("system", "branch", "commit", "success", "targets")).alias("json")
    )

"""Failure roll-ups by owner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.skew import MIN_ROWS, MOST, lookup_join, pieces
from buildgraph.functions.text import decode_id


def _failed_owners(results: DataFrame, empty_as_null: bool) -> DataFrame:
    failed = results.filter(F.col("status") == "failed")
    rows = failed.select("tree_path", "system", "exit_code", F.explode_outer("owners").alias("o"))
    discord, github = F.col("o.discord"), F.col("o.github")
    if empty_as_null:
        discord, github = F.nullif(discord, F.lit("")), F.nullif(github, F.lit(""))
    return rows.select(
        F.coalesce(discord, github, F.lit("unknown")).alias("owner"),
        "tree_path",
        "system",
        "exit_code",
    )


def failures_by_owner(results: DataFrame, empty_as_null: bool = False) -> DataFrame:
    """Failed targets per owner: owner, decoded id, count, and all systems of the run.

    The owner is the discord name, else the github name, else ``unknown``;
    targets without owners count under ``unknown``.  ``owner_id`` is the
    decoded discord id when it is made of digits.  With ``empty_as_null`` an
    empty name counts as missing.
    """
    # One row per platform name reaches this list, not one per target.
    systems = results.select("system").distinct().agg(
        F.array_join(F.sort_array(F.collect_list("system")), ", ").alias("systems")
    )
    per_owner = _failed_owners(results, empty_as_null).groupBy("owner").agg(
        F.count(F.lit(1)).alias("n_failed")
    )
    return per_owner.select(
        "owner", decode_id("owner").alias("owner_id"), "n_failed", systems.scalar().alias("systems")
    )


def owner_failures(
    results: DataFrame, empty_as_null: bool = False, hot_rows: int = MIN_ROWS
) -> DataFrame:
    """The failed targets of each owner, one row each, with the owner's total.

    ``exit_text`` is ``(exit n)``, or empty without an exit code.
    """
    rows = _failed_owners(results, empty_as_null)
    totals = rows.groupBy("owner").agg(F.count(F.lit(1)).alias("n_failed"))
    heavy = totals.filter(F.col("n_failed") >= hot_rows)
    hot = heavy.orderBy(F.col("n_failed").desc(), "owner").limit(MOST)
    hot = hot.select("owner", pieces(F.col("n_failed"), hot_rows).alias("_pieces"))
    exit_text = F.when(
        F.col("exit_code").isNotNull(), F.concat(F.lit("(exit "), "exit_code", F.lit(")"))
    ).otherwise("")
    return lookup_join(
        rows, totals, ["owner"], "inner", spread=["tree_path"], hot=hot
    ).select("owner", "n_failed", "tree_path", "system", "exit_code", exit_text.alias("exit_text"))


def success_summary(results: DataFrame) -> DataFrame:
    """Total number of targets when nothing failed; no row otherwise."""
    totals = results.agg(
        F.count(F.lit(1)).alias("targets"), F.count_if(F.col("status") == "failed").alias("_bad")
    )
    return totals.filter(F.col("_bad") == 0).select("targets")

"""Snapshot comparison: what was added, changed, removed or left alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.text import split_system

ADDED, CHANGED, UNCHANGED, REMOVED = "added", "changed", "unchanged", "removed"

# Names and texts of generated build steps.
FIRST_STEP = "pipeline-gen"
FINAL_STEP = "ci-post-build"
FINAL_LABEL = ":point_up: post-build"
DARWIN_SKIP = "no macOS Buildkite agent available"


def diff_snapshots(
    parent: DataFrame,
    current: DataFrame,
    key: str = "tree_path",
    fingerprint: str = "drv_path",
) -> DataFrame:
    """Compare two snapshots by ``key``: one row per key of either side.

    ``change`` is added, changed, unchanged or removed; only ``fingerprint``
    decides between changed and unchanged, so edits to other columns alone are
    "unchanged".  Columns come from ``current``, or from ``parent`` for removed
    keys; ``parent_<fingerprint>`` holds the old fingerprint.
    """
    others = [c for c in current.columns if c != key]
    p = parent.select(key, *[F.col(c).alias(f"_p_{c}") for c in others], F.lit(True).alias("_p"))
    c = current.select(key, *[F.col(o).alias(f"_c_{o}") for o in others], F.lit(True).alias("_c"))
    joined = p.join(c, key, "full_outer")
    change = (
        F.when(F.col("_p").isNull(), ADDED)
        .when(F.col("_c").isNull(), REMOVED)
        .when(F.col(f"_p_{fingerprint}").eqNullSafe(F.col(f"_c_{fingerprint}")), UNCHANGED)
        .otherwise(CHANGED)
    )
    return joined.select(
        key,
        change.alias("change"),
        *[
            F.when(F.col("_c").isNull(), F.col(f"_p_{o}")).otherwise(F.col(f"_c_{o}")).alias(o)
            for o in others
        ],
        F.col(f"_p_{fingerprint}").alias(f"parent_{fingerprint}"),
    )


def changed_targets(
    parent: DataFrame,
    current: DataFrame,
    key: str = "tree_path",
    fingerprint: str = "drv_path",
) -> DataFrame:
    """Targets whose fingerprint is missing from or different in the parent snapshot."""
    known = parent.select(key, fingerprint)
    return current.join(known, [key, fingerprint], "left_anti")


def to_build(diff: DataFrame) -> DataFrame:
    """Added and changed targets of a diff."""
    return diff.filter(F.col("change").isin(ADDED, CHANGED))


def removed(diff: DataFrame) -> DataFrame:
    """Targets that only the parent snapshot has."""
    return diff.filter(F.col("change") == REMOVED)


def subtract(df: DataFrame, excluded: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not excluded."""
    return df.join(excluded.select(key), key, "left_anti")


def by_system(df: DataFrame) -> DataFrame:
    """Target count per system; a null system counts under the empty string."""
    return df.groupBy(F.coalesce("system", F.lit("")).alias("system")).agg(
        F.count(F.lit(1)).alias("targets")
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """Counts per class, their changed total, and what must be built per system.

    Rows are (measure, system, targets): the four classes and ``to_build`` with
    a null system, then ``to_build`` per system.
    """
    build = F.col("change").isin(ADDED, CHANGED)
    per_system = diff.groupBy(F.coalesce("system", F.lit("")).alias("system")).agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in (ADDED, CHANGED, UNCHANGED, REMOVED)],
        F.count_if(build).alias("to_build"),
    )
    measures = (ADDED, CHANGED, UNCHANGED, REMOVED, "to_build")
    rows = per_system.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("measure"),
                        F.lit(None).cast("string").alias("system"),
                        F.col(m).alias("targets"),
                    )
                    for m in measures
                ],
                F.struct(
                    F.lit("to_build").alias("measure"),
                    F.col("system").alias("system"),
                    F.col("to_build").alias("targets"),
                ),
            )
        ).alias("r")
    ).select("r.*")
    summed = rows.groupBy("measure", "system").agg(F.sum("targets").alias("targets"))
    return summed.filter(F.col("system").isNull() | (F.col("targets") > 0))


def scope_system(df: DataFrame, system: str) -> DataFrame:
    """Targets of one system; an empty name keeps all."""
    if not system:
        return df
    return df.filter(F.coalesce("system", F.lit("")) == system)


def scope_platform(df: DataFrame, current: str) -> DataFrame:
    """Targets of the current platform; a null system counts as current."""
    return df.filter(F.coalesce("system", F.lit(current)) == current)


def system_plan(changed: DataFrame) -> DataFrame:
    """Build plan: one step per system with targets, and a final step depending on all of them.

    The final step exists only if there is any build step.  Steps of a system
    whose os part is ``darwin`` carry a skip reason.
    """
    arch, os = split_system("system")
    steps = by_system(changed).select(
        F.concat(F.lit(":nix: build "), "system", F.lit(" ("), "targets", F.lit(")")).alias("label"),
        F.concat(F.lit("build-"), F.replace("system", F.lit("."), F.lit("-"))).alias("key"),
        F.when(os == "darwin", F.lit(DARWIN_SKIP)).alias("skip"),
        F.array(F.lit(FIRST_STEP)).alias("depends_on"),
        arch.alias("arch"),
        os.alias("os"),
        F.col("system").alias("system"),
    )
    # One row per platform name reaches this list, not one per target.
    last = steps.agg(F.sort_array(F.collect_list("key")).alias("depends_on")).filter(
        F.size("depends_on") > 0
    )
    none = F.lit(None).cast("string")
    final = last.select(
        F.lit(FINAL_LABEL).alias("label"),
        F.lit(FINAL_STEP).alias("key"),
        none.alias("skip"),
        "depends_on",
        none.alias("arch"),
        none.alias("os"),
        none.alias("system"),
    )
    return steps.unionByName(final)


def output_roots(targets: DataFrame) -> DataFrame:
    """Every output path of every target."""
    return targets.select("tree_path", F.explode(F.map_values("outputs")).alias("output"))


def mismatches(declared: DataFrame, derived: DataFrame, key: str = "tree_path") -> DataFrame:
    """Targets whose declared system differs from the derived one."""
    d = declared.select(key, F.col("system").alias("declared"))
    r = derived.select(key, F.col("system").alias("derived"))
    return d.join(r, key).filter(~F.col("declared").eqNullSafe(F.col("derived")))

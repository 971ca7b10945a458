"""Status tables and generated pipeline steps as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.ordered import number_rows
from buildgraph.functions.text import duration_text
from buildgraph.operators.state import state_counts

# Icons of target types and states.
TYPE_BADGES = {
    "nixos-system": ":nix:",
    "darwin-system": ":mac:",
    "home-manager-system": ":house_with_garden:",
    "formatting-check": ":mag:",
    "shell": ":shell:",
}
OTHER_BADGE = ":package:"
STATE_ICONS = {
    "pending": ":hourglass:",
    "building": ":hammer:",
    "succeeded": ":white_check_mark:",
    "failed": ":x:",
    "skipped": ":no_entry_sign:",
}
NOTHING = "—"


def _choose(col: Column, values: dict[str, str], otherwise: str | None = None) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), col)
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def type_badge(dev_attr_type: str | Column) -> Column:
    """Badge of a target type."""
    c = F.col(dev_attr_type) if isinstance(dev_attr_type, str) else dev_attr_type
    return F.when(c.isNull(), F.lit(OTHER_BADGE)).otherwise(_choose(c, TYPE_BADGES, OTHER_BADGE))


def owner_names(owners: str | Column, mark: str = "", none: str = NOTHING) -> Column:
    """Owner names joined by commas: github, else discord, else ``?``."""
    o = F.col(owners) if isinstance(owners, str) else owners
    named = F.transform(
        o, lambda x: F.concat(F.lit(mark), F.coalesce(x["github"], x["discord"], F.lit("?")))
    )
    empty = o.isNull() | (F.size(o) == 0)
    return F.when(empty, F.lit(none)).otherwise(F.array_join(named, ", "))


def status_report(state: DataFrame) -> DataFrame:
    """Report row per target: icon, badge, path, duration text, owners; ordered by path.

    ``duration_ms`` is the contract, the text is for display.  A building
    target shows ``elapsed_ms`` since its first open start.
    """
    s = F.col("state")
    ms = F.when(s == "building", F.col("elapsed_ms")).when(
        s.isin("succeeded", "failed") & (F.col("duration_ms") > 0), F.col("duration_ms")
    )
    return state.select(
        "tree_path",
        _choose(s, STATE_ICONS).alias("icon"),
        type_badge("dev_attr_type").alias("badge"),
        F.coalesce("duration_ms", F.lit(0)).cast("bigint").alias("duration_ms"),
        F.coalesce(duration_text(ms), F.lit(NOTHING)).alias("duration_text"),
        owner_names("owners").alias("owner_names"),
    ).orderBy("tree_path")


def report_header(state: DataFrame, by: Sequence[str] = ("system",)) -> DataFrame:
    """Counts and headline per system; skipped targets count as failures."""
    counts = state_counts(state, by)

    def part(col: str, before: str, after: str) -> Column:
        return F.when(
            F.col(col) > 0, F.concat(F.lit(before), F.col(col), F.lit(after))
        ).otherwise("")

    title = F.concat(
        F.lit("### Build: "),
        F.col(by[0]),
        F.lit(" — "),
        F.col("succeeded"),
        F.lit(" succeeded, "),
        F.col("failures"),
        F.lit(" failed"),
        part("skipped", " (", " skipped: dependency failure)"),
        part("building", " | ", " building"),
        part("pending", " | ", " pending"),
    )
    return counts.withColumn("headline", title)


def failure_report(state: DataFrame) -> DataFrame:
    """Failed and skipped targets with reason, owners and log tail; failed ones first."""
    s = F.col("state")
    reason = F.when(s == "skipped", "skipped (dependency failure)").otherwise(
        F.coalesce(F.concat(F.lit("exit code "), "exit_code"), F.lit("unknown exit"))
    )
    return (
        state.filter(s.isin("failed", "skipped"))
        .select(
            "state",
            "tree_path",
            type_badge("dev_attr_type").alias("badge"),
            reason.alias("reason"),
            owner_names("owners", "@", "none").alias("owner_names"),
            F.when(s == "failed", F.col("log_tail")).alias("log_tail"),
        )
        .orderBy("state", "tree_path")
    )


def extra_steps(steps: DataFrame, build_enabled: bool = True) -> DataFrame:
    """Extra steps of targets with inherited skip.

    ``steps`` has label, parent_label, parent_key, parent_skip, own_skip (null:
    not set), always_run and needs_output.  A step that always runs is never
    skipped; its own skip reason beats the parent's.  It depends on its parent
    unless it always runs or takes the parent's output itself.
    """
    skip = F.when(~F.col("always_run"), F.coalesce("own_skip", "parent_skip"))
    depends = F.lit(build_enabled) & ~F.col("always_run") & ~F.col("needs_output")
    return steps.select(
        F.concat(
            F.lit("extra-step-"), F.sha1(F.concat("label", F.lit("-"), "parent_label"))
        ).alias("key"),
        F.concat(F.lit(":gear: "), "label", F.lit(" (from "), "parent_label", F.lit(")")).alias(
            "label"
        ),
        skip.alias("skip"),
        F.when(depends, F.col("parent_key")).alias("depends_on"),
    )


def steps_by_phase(
    steps: DataFrame,
    phases: Sequence[str],
    active: Sequence[str] | None = None,
    order: Sequence[str] = ("is_global", "target_pos", "step_pos", "key"),
) -> DataFrame:
    """Steps of the enabled phases in upload order, numbered within each phase.

    Target steps come first, in target order, then global steps.  Enabled are
    the known phases that are active, in the order they are declared.
    ``position`` feeds :func:`buildgraph.operators.chunking.chunk`.
    """
    enabled = [p for p in phases if active is None or p in active]
    kept = steps.filter(F.col("phase").isin(*enabled)).select("phase", "key", *[c for c in order if c != "key"])
    numbered = number_rows(kept, ["phase"], list(order))
    place = F.array_position(F.array(*[F.lit(p) for p in enabled]), F.col("phase"))
    return numbered.select("phase", place.cast("int").alias("phase_order"), "position", "key")

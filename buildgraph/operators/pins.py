"""Version pins: status, staleness, lockfile integrity and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.skew import MIN_ROWS, lookup_join
from buildgraph.functions.text import REGISTRY

FAILURE, STALE, CLEAN = 2, 1, 0


def version_status(pins: DataFrame, registry: DataFrame, installed: DataFrame) -> DataFrame:
    """Pinned, latest and installed version per package.

    ``latest`` shows ``ERR (reason)`` when the registry gave none, ``installed``
    is ``-`` when missing.  ``registry`` has npm_name, latest, error.
    """
    latest = F.coalesce(
        "latest",
        F.concat(F.lit("ERR ("), F.coalesce("error", F.lit("no registry document")), F.lit(")")),
    )
    return (
        pins.select("npm_name", "pinned_version")
        .join(registry.select("npm_name", "latest", "error"), "npm_name", "left")
        .join(installed.select("npm_name", F.col("version").alias("_v")), "npm_name", "left")
        .select(
            F.col("npm_name").alias("package"),
            F.col("pinned_version").alias("pinned"),
            latest.alias("latest"),
            F.coalesce("_v", F.lit("-")).alias("installed"),
        )
    )


def check_pins(pins: DataFrame, reference: DataFrame, against: str = "latest") -> DataFrame:
    """Findings about pins: rows (npm_name, pinned, reference, severity, reason).

    Against ``latest`` (npm_name, latest, error) a missing answer is a failure
    (severity 2), not stale.  Against ``installed`` (npm_name, version) a
    missing install is stale (1) with ``<not installed>``.  Otherwise a pin
    that differs from the reference is stale.
    """
    p = pins.select("npm_name", F.col("pinned_version").alias("pinned"))
    if against == "latest":
        r = reference.select("npm_name", F.col("latest").alias("reference"), "error")
        severity = F.when(F.col("reference").isNull(), FAILURE)
        reason = F.when(
            F.col("reference").isNull(), F.coalesce("error", F.lit("no registry document"))
        )
    elif against == "installed":
        r = reference.select("npm_name", F.col("version").alias("reference"))
        severity = F.when(F.col("reference").isNull(), STALE)
        reason = F.lit(None).cast("string")
    else:
        raise ValueError("against must be 'latest' or 'installed'")
    joined = p.join(r, "npm_name", "left").withColumns(
        {
            "severity": severity.when(F.col("reference") != F.col("pinned"), STALE).otherwise(CLEAN),
            "reason": reason,
        }
    )
    shown = F.col("reference")
    if against == "installed":
        shown = F.coalesce(shown, F.lit("<not installed>"))
    return joined.filter(F.col("severity") > CLEAN).select(
        "npm_name", "pinned", shown.alias("reference"), "severity", "reason"
    )


def exit_severity(findings: DataFrame) -> DataFrame:
    """2 if anything failed, else 1 if anything is stale, else 0."""
    return findings.agg(F.coalesce(F.max("severity"), F.lit(CLEAN)).alias("exit_code"))


def backfill_integrity(
    lock: DataFrame, registry: DataFrame, hot_rows: int = MIN_ROWS, prefix: str = REGISTRY + "/"
) -> DataFrame:
    """Lockfile entries with missing integrity restored from the registry.

    Only entries without the attribute, from the registry and with a version
    are looked up, by (name, version).  ``outcome`` is ``fixed``, ``missing``
    (the registry has none) or ``untouched``.  A popular package occurs in very
    many lockfiles, so hot (name, version) pairs are split.
    """
    wanted = (
        ~F.col("has_integrity")
        & F.startswith(F.coalesce("resolved", F.lit("")), F.lit(prefix))
        & (F.coalesce("version", F.lit("")) != "")
    )
    r = registry.select("name", "version", F.nullif("integrity", F.lit("")).alias("_found"))
    wanted = F.coalesce(wanted, F.lit(False))
    joined = lookup_join(lock.filter(wanted), r, ["name", "version"], "left", min_rows=hot_rows)
    looked_up = joined.withColumns(
        {
            "integrity": F.coalesce("_found", "integrity"),
            "outcome": F.when(F.col("_found").isNotNull(), "fixed").otherwise("missing"),
        }
    ).select(*lock.columns, "outcome")
    # The others pass through without an exchange.
    return lock.filter(~wanted).withColumn("outcome", F.lit("untouched")).unionByName(looked_up)


def fix_counts(backfilled: DataFrame) -> DataFrame:
    """Fixed and unfixable entries per lockfile."""
    return backfilled.groupBy("file").agg(
        F.count_if(F.col("outcome") == "fixed").alias("fixed"),
        F.count_if(F.col("outcome") == "missing").alias("missing"),
    )


def collisions(new: DataFrame, pins: DataFrame, dirs: DataFrame) -> DataFrame:
    """New packages that can not be added: already pinned, else folder exists.

    ``new`` has npm_name and dir_name; ``dirs`` has dir_name.
    """
    pinned = pins.select("npm_name", F.col("pinned_version").alias("_pinned"))
    present = dirs.select("dir_name", F.lit(True).alias("_there")).distinct()
    reason = F.coalesce(
        F.concat("npm_name", F.lit(" is already pinned ("), "_pinned", F.lit(")")),
        F.when(F.col("_there"), F.concat("dir_name", F.lit(" already exists"))),
    )
    return (
        new.join(pinned, "npm_name", "left")
        .join(present, "dir_name", "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("npm_name", "dir_name", "reason")
    )


def select_targets(
    pins: DataFrame, requested: DataFrame | None = None, everything: bool = False
) -> DataFrame:
    """Pins chosen by directory or package name, in request order.

    ``requested`` has pos and name.  A package name beats a directory name.
    An unknown name gives a row with ``error``.  Asking for nothing raises.
    """
    if everything:
        return pins
    if requested is None:
        raise ValueError("no packages given: pass names or ask for all")
    aliases = pins.select("*", F.col("npm_name").alias("_alias"), F.lit(0).alias("_rank")).unionByName(
        pins.select("*", F.col("dir_name").alias("_alias"), F.lit(1).alias("_rank"))
    )
    row = F.struct(*pins.columns)
    # Package names beat directory names; ties take the smaller package name.
    best = aliases.groupBy("_alias").agg(
        F.min_by(row, F.struct("_rank", "npm_name")).alias("_pin")
    )
    found = requested.join(best, requested["name"] == best["_alias"], "left")
    error = F.when(
        F.col("_pin").isNull(), F.concat(F.lit("unknown package '"), "name", F.lit("'"))
    )
    return found.select(
        "pos",
        F.col("name").alias("requested"),
        *[F.col(f"_pin.{c}").alias(c) for c in pins.columns],
        error.alias("error"),
    ).orderBy("pos")

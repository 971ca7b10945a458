"""Feature resolution over a package graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.skew import MIN_ROWS, StoredTable, lookup_join
from buildgraph.functions.storage import Rounds, materialize_counted, numbered

#: Marks a selected package in the state; it is no feature.
SELECTED = ""


def dep_name() -> Column:
    """Name features use for a dependency: its rename, else its name."""
    return F.coalesce("rename", "name")


def _enabling_name(feature: Column) -> Column:
    """Dependency a feature enables: ``x``, ``dep:x`` and ``x/y`` all enable ``x``."""
    return F.when(
        F.startswith(feature, F.lit("dep:")), F.substring(feature, 5, 1 << 30)
    ).otherwise(F.substring_index(feature, "/", 1))


def _handed_on() -> Column:
    """What an enabled edge gives its dependency, whatever features enabled it."""
    none = F.array().cast("array<string>")
    return F.concat(
        F.array(F.lit(SELECTED)),
        F.when(F.coalesce("uses_default", F.lit(True)), F.array(F.lit("default"))).otherwise(none),
        F.coalesce("features", none),
    )


def _rules(deps: DataFrame, feature_map: DataFrame) -> DataFrame:
    """All one-premise rules: (package_id, kind, name) gives (to_id, gives).

    ``feature``: the package has the feature.  ``enable``: a feature enables
    the named optional dependency.  ``pass``: the rest of ``name/f`` goes to
    the dependency (``gives`` is null).  ``weak`` / ``weak_optional``: the rest
    of ``name?/f`` does, at once or once the edge is on.
    """
    edges = deps.select(
        "package_id",
        dep_name().alias("name"),
        "dep_id",
        F.coalesce("optional", F.lit(False)).alias("optional"),
        F.coalesce("target_ok", F.lit(True)).alias("target_ok"),
        _handed_on().alias("gives"),
    )
    here = edges.filter("target_ok")

    def rule(df: DataFrame, kind: str, name: Column, to: str, gives: Column) -> DataFrame:
        return df.select(
            "package_id", F.lit(kind).alias("kind"), name.alias("name"),
            F.col(to).alias("to_id"), gives.alias("gives"),
        )

    name, given = F.col("name"), F.explode("gives")
    nothing = F.lit(None).cast("string")
    parts = [
        rule(feature_map, "feature", F.col("feature"), "package_id", F.explode("enables")),
        rule(here.filter("NOT optional"), "feature", F.lit(SELECTED), "dep_id", given),
        rule(edges.filter("optional"), "enable", name, "package_id", name),
        rule(here.filter("optional"), "enable", name, "dep_id", given),
        rule(here, "pass", name, "dep_id", nothing),
        rule(here.filter("NOT optional"), "weak", name, "dep_id", nothing),
        rule(here.filter("optional"), "weak_optional", name, "dep_id", nothing),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


# A state row as rule premises: the feature itself, the dependency it enables,
# and the rest of `name/f` and `name?/f`.
_PREMISES = """inline(filter(array(
    struct('feature' AS kind, feature AS name, CAST(NULL AS STRING) AS rest),
    if(feature <> '' AND NOT contains(feature, '?/'), struct('enable' AS kind,
        if(startswith(feature, 'dep:'), substring(feature, 5), substring_index(feature, '/', 1)) AS name,
        CAST(NULL AS STRING) AS rest), NULL),
    if(contains(feature, '/') AND NOT contains(feature, '?/'), struct('pass' AS kind,
        substring_index(feature, '/', 1) AS name, substring(feature, instr(feature, '/') + 1) AS rest), NULL),
    if(contains(feature, '?/'), struct('weak' AS kind,
        substring_index(feature, '?/', 1) AS name, substring(feature, instr(feature, '?/') + 2) AS rest), NULL)
), p -> p IS NOT NULL))"""


def _probes(state: DataFrame) -> DataFrame:
    """State rows as rule premises (package_id, kind, name, rest)."""
    return state.selectExpr("package_id", _PREMISES)


def resolve_features(
    packages: DataFrame,
    deps: DataFrame,
    feature_map: DataFrame,
    roots: DataFrame,
    max_rounds: int | None = None,
    hot_rows: int = MIN_ROWS,
) -> DataFrame:
    """Least fixpoint of enabled features: rows (package_id, feature).

    ``roots`` (package_id, feature) selects packages.  ``feature_map``
    (package_id, feature, enables array) expands features.  ``deps`` has
    package_id, dep_id, name, rename, optional, uses_default, features array
    and target_ok.  An optional dependency is enabled by a feature ``name``,
    ``dep:name`` or ``name/...`` and then counts as feature ``name``.  An
    enabled edge selects the dependency and passes on ``default`` (unless
    switched off), its listed features, and the rest of ``name/f`` and
    ``name?/f``.  Features add up over all paths.  A selected package without
    features appears once with a null feature.

    All rules but one have a single premise, so a round is one join of the
    newest rows with the rule table; ``name?/f`` on an optional edge also needs
    the edge to be on, which its name among the features tells.
    """
    known = packages.select(F.col("package_id").alias("dep_id")).distinct()
    usable = deps.join(known, "dep_id", "left_semi")
    keys = ["package_id", "kind", "name"]
    rules = StoredTable(_rules(usable, feature_map), keys, ["to_id", "gives"], hot_rows)
    start = roots.select("package_id", F.lit(SELECTED).alias("feature")).unionByName(
        roots.filter(F.col("feature").isNotNull()).select("package_id", "feature")
    )
    new, n = materialize_counted(start.distinct(), "features")
    rounds = Rounds(new)
    for _ in numbered(max_rounds):
        if n == 0:
            break
        state = rounds.all()

        def waiting(rows: DataFrame) -> DataFrame:
            return rows.filter("contains(feature, '?/')").selectExpr(
                "package_id",
                "'weak_optional' AS kind",
                "substring_index(feature, '?/', 1) AS name",
                "substring(feature, instr(feature, '?/') + 2) AS rest",
            )

        def named(rows: DataFrame) -> DataFrame:
            return rows.selectExpr("package_id", "feature AS name")

        pair = ["package_id", "name"]
        weak = (
            waiting(new)
            .join(named(state), pair, "left_semi")
            .unionByName(waiting(state).join(named(new), pair, "left_semi"))
        )
        found = (
            rules.join(_probes(new).unionByName(weak))
            .selectExpr("to_id AS package_id", "coalesce(gives, rest) AS feature")
            .distinct()
        )
        new, n = materialize_counted(
            found.join(state, ["package_id", "feature"], "left_anti"), "features"
        )
        if n:
            rounds.add(new)
    else:
        raise RuntimeError(f"feature resolution did not end within {max_rounds} rounds")
    state = rounds.all()
    features = state.filter(F.col("feature") != SELECTED)
    bare = (
        state.filter(F.col("feature") == SELECTED)
        .select("package_id")
        .join(features.select("package_id"), "package_id", "left_anti")
        .withColumn("feature", F.lit(None).cast("string"))
    )
    return features.unionByName(bare)


def enabled_edges(deps: DataFrame, features: DataFrame) -> DataFrame:
    """Dependencies that are on: the target matches and the edge is required or enabled.

    ``features`` is the output of :func:`resolve_features`; packages missing
    there are not selected and have no enabled edges.
    """
    present = features.select("package_id").distinct()
    enabling = (
        features.filter(F.col("feature").isNotNull() & ~F.contains("feature", F.lit("?/")))
        .select("package_id", _enabling_name(F.col("feature")).alias("_dep"))
        .distinct()
        .withColumn("_on", F.lit(True))
    )
    candidates = deps.filter(F.coalesce("target_ok", F.lit(True))).withColumn("_dep", dep_name())
    flagged = candidates.join(present, "package_id", "left_semi").join(
        enabling, ["package_id", "_dep"], "left"
    )
    required = ~F.coalesce("optional", F.lit(False))
    return flagged.filter(required | F.coalesce("_on", F.lit(False))).select(*deps.columns)


def rename_groups(deps: DataFrame, packages: DataFrame) -> DataFrame:
    """Renames of enabled dependencies: rows (package_id, name, version, rename).

    The rows of one (package_id, name) are the group.
    """
    versions = packages.select(F.col("package_id").alias("dep_id"), "version")
    renamed = deps.filter(F.col("rename").isNotNull()).select(
        "package_id", "name", "dep_id", "rename"
    )
    joined = lookup_join(renamed, versions, ["dep_id"], "inner")
    return joined.select("package_id", "name", "version", "rename")


def compare_sets(left: DataFrame, right: DataFrame, key: str = "package_id", item: str = "feature") -> DataFrame:
    """Compare two tables of (key, item) sets.

    Returns keys that differ: ``only_left``, ``only_right`` or ``different``
    with the number of items on one side only.  A null item stands for an empty
    set.  Items are compared row by row; no set is gathered into one value.
    """
    l = left.select(key, item).distinct().withColumn("_l", F.lit(1))
    r = right.select(key, item).distinct().withColumn("_r", F.lit(1))
    both = l.join(
        r, (l[key] == r[key]) & l[item].eqNullSafe(r[item]), "full_outer"
    ).select(F.coalesce(l[key], r[key]).alias(key), l[item].alias("_li"), r[item].alias("_ri"), "_l", "_r")
    per_key = both.groupBy(key).agg(
        F.count("_l").alias("_nl"),
        F.count("_r").alias("_nr"),
        F.count_if(F.col("_r").isNull() & F.col("_li").isNotNull()).alias("left_items"),
        F.count_if(F.col("_l").isNull() & F.col("_ri").isNotNull()).alias("right_items"),
    )
    kind = (
        F.when(F.col("_nr") == 0, "only_left")
        .when(F.col("_nl") == 0, "only_right")
        .when((F.col("left_items") > 0) | (F.col("right_items") > 0), "different")
    )
    return (
        per_key.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select(key, "kind", "left_items", "right_items")
    )

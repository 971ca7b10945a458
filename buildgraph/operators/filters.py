"""Predicates, audits and rule checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.skew import lookup_join
from buildgraph.functions.storage import materialize

# Failure texts that make a build worth retrying.
TRANSIENT_PATTERNS = (
    "curl error",
    "unable to download",
    "Connection refused",
    "connection refused",
    "timeout",
    "Timed out",
    "ssh: connect to host",
    "broken pipe",
    "Broken pipe",
    "remote builder unavailable",
    "unexpected end-of-file",
    "cannot connect to",
    "HTTP 502",
    "HTTP 503",
    "HTTP 504",
    "Could not resolve host",
    "Temporary failure in name resolution",
    "No route to host",
)

SKIP_TREE, SKIP_SUBTREE = ".skip-tree", ".skip-subtree"


def eligible(
    df: DataFrame,
    excluded: DataFrame | None = None,
    prefix: str | None = "pipelines",
    key: str = "tree_path",
) -> DataFrame:
    """Targets worth building.

    A target has an output, is not broken, is not opted out, is not in
    ``excluded`` and does not lie under the top folder ``prefix``.
    Columns: ``has_output``, ``broken``, ``ci_skip``, ``parts``.
    """
    out = df.filter(
        F.coalesce("has_output", F.lit(False))
        & ~F.coalesce("broken", F.lit(False))
        & ~F.coalesce("ci_skip", F.lit(False))
    )
    if prefix is not None:
        out = out.filter(~F.get("parts", F.lit(0)).eqNullSafe(F.lit(prefix)))
    if excluded is not None:
        out = out.join(excluded.select(key), key, "left_anti")
    return out


def visible_targets(files: DataFrame) -> DataFrame:
    """Targets of a repository tree, from its file inventory (``parts array<string>``).

    Hidden files and anything below hidden folders do not count.  A folder with
    a skip-tree marker is dropped wholly; with a skip-subtree marker it keeps
    only its own ``default.nix``.  A folder's ``default.nix`` is the target of
    the folder; beside it only ``shell.nix`` is a target, and without it every
    ``*.nix`` file is.  The root folder itself is no target.  A skip-tree marker
    at the root is an error.  Returns ``parts`` of the target and its ``file``.
    """
    name = F.element_at("parts", -1)
    folder = F.slice("parts", 1, F.size("parts") - 1)
    listed = files.filter(
        ~F.exists(folder, lambda p: F.startswith(p, F.lit(".")))
    ).select(folder.alias("folder"), name.alias("name"), F.array_join(folder, "/").alias("dir"))
    listed = listed.filter(
        F.endswith("name", F.lit(".nix")) & ~F.startswith("name", F.lit("."))
        | F.col("name").isin(SKIP_TREE, SKIP_SUBTREE)
    )
    # One row per folder, read several times below.
    dirs = materialize(
        listed.groupBy("dir").agg(
            F.max(F.col("name") == "default.nix").alias("has_default"),
            F.max(F.col("name") == SKIP_TREE).alias("tree"),
            F.max(F.col("name") == SKIP_SUBTREE).alias("subtree"),
        ),
        "folders",
    )
    marked = dirs.filter("tree OR subtree").select(
        F.when(
            (F.col("dir") == "") & F.col("tree"),
            F.raise_error("the top folder carries a skip-tree marker").cast("string"),
        )
        .otherwise(F.col("dir"))
        .alias("above"),
        F.col("tree").alias("above_tree"),
    )
    # Every folder with each folder at or above it; the marker list is short.
    split = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(split))
    lineage = dirs.select(
        "dir",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), depth), lambda n: F.array_join(F.slice(split, 1, n), "/")
            )
        ).alias("above"),
    )
    dropped = (
        lookup_join(lineage, marked, ["above"], "inner", spread=["dir"])
        .filter(F.col("above_tree") | (F.col("above") != F.col("dir")))
        .select("dir")
        .distinct()
    )
    # The lineage is exploded, so the size of what is dropped cannot be guessed.
    kept = dirs.join(dropped.hint("merge"), "dir", "left_anti").select("dir", "has_default", "subtree")
    nix = listed.filter(F.endswith("name", F.lit(".nix")))
    joined = lookup_join(nix, kept, ["dir"], "inner", spread=["name"])
    is_default = F.col("name") == "default.nix"
    wanted = joined.filter(
        F.when(is_default, F.col("dir") != "")
        .when(F.col("subtree"), False)
        .when(F.col("has_default"), F.col("name") == "shell.nix")
        .otherwise(True)
    )
    stem = F.regexp_replace("name", r"\.nix$", "")
    return wanted.select(
        F.when(is_default, F.col("folder"))
        .otherwise(F.concat("folder", F.array(stem)))
        .alias("parts"),
        F.concat_ws("/", F.col("folder"), F.array("name")).alias("file"),
    )


class PathRule(NamedTuple):
    """One rule over a path's base name.  ``kind`` restricts it to that file type."""

    test: str  # suffix, prefix, name or match
    value: str | Sequence[str]
    kind: str | None = None


def _rule(rule: PathRule, base: Column) -> Column:
    if rule.test == "suffix":
        hit = F.endswith(base, F.lit(rule.value))
    elif rule.test == "prefix":
        hit = F.startswith(base, F.lit(rule.value))
    elif rule.test == "name":
        names = [rule.value] if isinstance(rule.value, str) else list(rule.value)
        hit = base.isin(names)
    elif rule.test == "match":
        hit = base.rlike(rule.value)
    else:
        raise ValueError(f"unknown path test {rule.test!r}")
    return hit if rule.kind is None else (F.col("type") == rule.kind) & hit


# The three source filters in use, over base names.
NIX_SOURCES = {
    "deny": (PathRule("name", ("_build", "target", "node_modules"), "directory"),),
    "allow": (PathRule("match", "", "directory"), PathRule("suffix", ".nix")),
}
TERRAFORM_SOURCES = {
    "deny": (PathRule("prefix", "."),),
    "allow": (PathRule("suffix", ".tf"),),
}
CRATE_SOURCES = {
    "deny": (
        PathRule("name", ".gitignore"),
        PathRule("name", ".git", "directory"),
        PathRule(
            "name",
            ("target", "_site", ".sass-cache", ".jekyll-metadata", "build-artifacts"),
            "directory",
        ),
        PathRule("prefix", "result", "symlink"),
        PathRule("name", (".idea", ".vscode"), "directory"),
        PathRule("suffix", ".iml"),
        PathRule("name", "Cargo.nix"),
        PathRule("suffix", "~"),
        PathRule("match", r"^\.sw[a-z]$"),
        PathRule("match", r"^\..*\.sw[a-z]$"),
        PathRule("suffix", ".tmp"),
        PathRule("suffix", ".bak"),
        PathRule("name", "tests.nix"),
    ),
    "allow": (),
}


def filter_paths(
    paths: DataFrame, deny: Iterable[PathRule] = (), allow: Iterable[PathRule] = ()
) -> DataFrame:
    """Paths (``path``, ``type``) that no deny rule hits and, if any are given, some allow rule does."""
    base = F.substring_index("path", "/", -1)
    keep = F.lit(True)
    for rule in deny:
        keep = keep & ~_rule(rule, base)
    allowed = [_rule(rule, base) for rule in allow]
    if allowed:
        some = allowed[0]
        for hit in allowed[1:]:
            some = some | hit
        keep = keep & some
    return paths.filter(keep)


def unowned(df: DataFrame) -> DataFrame:
    """Targets no owner of which has a non-empty github or discord name."""
    named = F.exists(
        "owners",
        lambda o: (F.coalesce(o["github"], F.lit("")) != "")
        | (F.coalesce(o["discord"], F.lit("")) != ""),
    )
    return df.filter(~F.coalesce(named, F.lit(False)))


def transient(log: str | Column, patterns: Sequence[str] = TRANSIENT_PATTERNS) -> Column:
    """Whether a log holds any of the literal, case-sensitive texts."""
    log = F.col(log) if isinstance(log, str) else log
    hits = F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(log, p))
    return F.coalesce(hits, F.lit(False))


def classify_transient(
    df: DataFrame,
    log_col: str = "log",
    patterns: Sequence[str] = TRANSIENT_PATTERNS,
    out: str = "transient",
) -> DataFrame:
    """Add whether a row's log looks like a transient failure."""
    return df.withColumn(out, transient(log_col, patterns))


class Rule(NamedTuple):
    """A named condition every row must satisfy; ``message`` may be a column."""

    name: str
    holds: Column
    message: str | Column


def check_rules(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """Violations of declarative rules, one row per broken rule, in a single pass.

    A rule whose condition is null counts as broken.
    """
    found = F.array(
        *[
            F.when(
                ~F.coalesce(r.holds, F.lit(False)),
                F.struct(
                    F.lit(r.name).alias("rule"),
                    (F.lit(r.message) if isinstance(r.message, str) else r.message).alias(
                        "message"
                    ),
                ),
            )
            for r in rules
        ]
    )
    return df.select(*keys, F.explode(F.filter(found, lambda v: v.isNotNull())).alias("v")).select(
        *keys, "v.rule", "v.message"
    )


def known_phase(phases: Sequence[str], phase: str = "phase") -> Rule:
    """The phase must be one of the known ones."""
    message = F.concat(
        F.lit("Phase '"), F.col(phase), F.lit("' is not valid. Known phases: " + ", ".join(phases))
    )
    return Rule("known_phase", F.col(phase).isin(*phases), message)


def no_prompt_in_build(phase: str = "phase", prompt: str = "prompt") -> Rule:
    """A step of the build phase must not wait for a person."""
    return Rule(
        "no_prompt_in_build",
        (F.col(phase) != "build") | F.col(prompt).isNull(),
        "a prompt can not be used by steps in the build phase",
    )


def public_key(key: str = "public_key") -> Rule:
    """A public key must start with ``ssh-``."""
    return Rule(
        "public_key",
        F.startswith(F.col(key), F.lit("ssh-")),
        F.concat(F.lit("invalid public key: "), F.col(key)),
    )


def tailnet_address(flag: str = "tailscale", address: str = "tailscale_addr") -> Rule:
    """A service on the private net needs an address."""
    return Rule(
        "tailnet_address",
        ~F.col(flag) | F.col(address).isNotNull(),
        "tailscaleAddr must be set because tailscale = true",
    )


def cache_settings(
    url: str = "url", key: str = "public_key", enabled: str = "cache_enabled"
) -> Rule:
    """An enabled cache client needs its address and public key."""
    return Rule(
        "cache_settings",
        ~F.col(enabled) | (F.col(url).isNotNull() & F.col(key).isNotNull()),
        "url and publicKey must be set when the client-side cache is enabled",
    )


def agent_count(count: str = "agent_count") -> Rule:
    """There must be at least one agent."""
    return Rule(
        "agent_count",
        F.col(count) > 0,
        F.concat(F.lit("agent count must be > 0, found "), F.col(count)),
    )


def audit_restricted(
    refs: DataFrame, folder: str, exceptions: DataFrame | None = None
) -> DataFrame:
    """References into a restricted top folder from places that may not make them.

    ``refs`` has ``from_parts`` and ``to_parts``.  Allowed are places inside the
    folder and exactly the listed ``parts`` of ``exceptions``.
    """
    into = refs.filter(
        (F.get("to_parts", F.lit(0)) == folder)
        & ~F.get("from_parts", F.lit(0)).eqNullSafe(F.lit(folder))
    )
    if exceptions is None:
        return into
    listed = exceptions.select(F.col("parts").alias("from_parts"))
    return into.join(listed, "from_parts", "left_anti")

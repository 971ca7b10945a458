"""Validated lookups, retention, list reconciliation, merging and routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.skew import MIN_ROWS, hot_keys, lookup_join
from buildgraph.functions.text import STORE_PREFIX, strip_trailing_slashes, valid_json


def lookup_chain(
    requests: DataFrame,
    sources: Sequence[tuple[str, DataFrame]],
    recomputed: DataFrame | None = None,
    hot_rows: int = MIN_ROWS,
) -> DataFrame:
    """First valid entry per request, trying the sources in turn.

    ``requests`` has commit and validator, every source one row per commit with
    validator and payload (JSON).  An entry is a ``hit`` only if its validator
    equals the request's, which must not be null, and its payload parses; else
    it is ``stale``, ``corrupt`` or a ``miss``.  ``recomputed`` (commit,
    payload) comes last and needs no validator; if that fails too, the payload
    is the empty map.  Adds ``<name>_outcome`` per source, ``origin`` and
    ``payload``.
    """
    hot = hot_keys(requests, ["commit"], hot_rows)
    entry = "struct<v: string, p: string, ok: boolean>"
    tagged = [
        entries.select(
            "commit",
            F.lit(i).alias("_source"),
            F.struct(
                F.col("validator").cast("string").alias("v"),
                F.col("payload").alias("p"),
                F.coalesce(valid_json("payload"), F.lit(False)).alias("ok"),
            ).cast(entry).alias("_entry"),
        )
        for i, (_, entries) in enumerate(sources)
    ]
    # One row per commit with its entry of every source; payloads are checked once, before the join.
    if tagged:
        every = tagged[0]
        for t in tagged[1:]:
            every = every.unionByName(t)
        chosen = [
            F.max_by("_entry", F.when(F.col("_source") == i, 1)).alias(f"_{name}")
            for i, (name, _) in enumerate(sources)
        ]
        out = lookup_join(requests, every.groupBy("commit").agg(*chosen), ["commit"], "left", hot=hot)
    else:
        out = requests
    for name, _ in sources:
        e = F.col(f"_{name}")
        valid = F.coalesce(F.col("validator").cast("string") == e["v"], F.lit(False))
        outcome = (
            F.when(e.isNull() | F.col("validator").isNull() | e["v"].isNull(), "miss")
            .when(~valid, "stale")
            .when(e["p"].isNull(), "miss")
            .when(~e["ok"], "corrupt")
            .otherwise("hit")
        )
        out = out.withColumns({f"{name}_outcome": outcome, f"_{name}_p": e["p"]})
    origin, payload = None, None
    for name, _ in sources:
        hit = F.col(f"{name}_outcome") == "hit"
        origin = F.when(hit, name) if origin is None else origin.when(hit, name)
        p = F.col(f"_{name}_p")
        payload = F.when(hit, p) if payload is None else payload.when(hit, p)
    if recomputed is not None:
        r = recomputed.select("commit", F.col("payload").alias("_again"))
        out = lookup_join(out, r, ["commit"], "left", hot=hot)
        again = F.col("_again").isNotNull()
        origin, payload = origin.when(again, "recomputed"), payload.when(again, F.col("_again"))
    out = out.withColumns({"origin": origin.otherwise("empty"), "payload": payload.otherwise("{}")})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def storable(entries: DataFrame) -> DataFrame:
    """Entries a cache may keep: those with a validator."""
    return entries.filter(F.col("validator").isNotNull())


def prune(entries: DataFrame, keep: DataFrame, on: Sequence[str] = ("repo", "commit")) -> DataFrame:
    """Entries to delete: those whose commit is not kept."""
    return entries.join(keep.select(*on), list(on), "left_anti")


def entry_state(entries: DataFrame, head: DataFrame, on: Sequence[str] = ("repo", "commit")) -> DataFrame:
    """State of HEAD's entry: current, stale or empty, and whether to create it.

    ``head`` has the wanted ``artifact``; ``entries`` the present one, null
    when the entry is something other than a link.
    """
    found = entries.select(
        *on, F.col("artifact").alias("_now"), F.lit(True).alias("_there")
    )
    state = (
        F.when(F.col("_there").isNull(), "empty")
        .when(F.col("_now") == F.col("artifact"), "current")
        .otherwise("stale")
    )
    return (
        head.join(found, list(on), "left")
        .withColumn("state", state)
        .withColumn("create", F.col("state") != "current")
        .drop("_now", "_there")
    )


def merge_right(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Union of two keyed tables in which rows of ``right`` win."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in left.columns if c not in keys]
    l = left.select(*keys, *[F.col(c).alias(f"_l_{c}") for c in others])
    r = right.select(
        *keys, *[F.col(c).alias(f"_r_{c}") for c in others], F.lit(True).alias("_right")
    )
    return l.join(r, keys, "full_outer").select(
        *keys,
        *[
            F.when(F.col("_right"), F.col(f"_r_{c}")).otherwise(F.col(f"_l_{c}")).alias(c)
            for c in others
        ],
    )


def _kept(declared_remove: Sequence[str]):
    gone = F.startswith("value", F.lit(STORE_PREFIX))
    if declared_remove:
        gone = gone | F.col("value").isin(*declared_remove)
    return F.col("is_object") | ~gone


def reconcile_lists(
    docs: DataFrame,
    entries: DataFrame,
    declared: Sequence[str],
    remove: Sequence[str] = (),
) -> DataFrame:
    """Managed lists after reconciliation, one row per entry.

    ``entries`` has doc_id, pos (0-based, dense), is_object and value.  Object
    entries stay; strings to remove and strings under the store folder go; the
    declared entries follow, each once, in order.  Every document of ``docs``
    gets them.  Rows are ordered by (part, pos): part 0 keeps old positions,
    part 1 is the declared list.
    """
    wanted = list(dict.fromkeys(declared))
    kept = entries.filter(_kept(remove)).select(
        "doc_id", F.lit(0).alias("part"), F.col("pos").cast("bigint").alias("pos"), "is_object", "value"
    )
    if not wanted:
        return kept
    added = docs.select(
        "doc_id",
        F.lit(1).alias("part"),
        F.posexplode(F.array(*[F.lit(w) for w in wanted])).alias("pos", "value"),
    ).select(
        "doc_id", "part", F.col("pos").cast("bigint").alias("pos"), F.lit(False).alias("is_object"), "value"
    )
    return kept.unionByName(added)


def reconciled_documents(
    docs: DataFrame,
    entries: DataFrame,
    declared: Sequence[str],
    remove: Sequence[str] = (),
    skills: Sequence[str] = (),
) -> DataFrame:
    """Per document whether reconciliation leaves it unchanged, and its new skills.

    ``docs`` has doc_id and skills (array).  Skills are replaced only by a
    non-empty list.  A list is unchanged exactly if the kept entries come first
    and the dropped ones equal the declared list in place; only counts and
    extreme positions are aggregated.
    """
    wanted = list(dict.fromkeys(declared))
    index = F.when(F.lit(False), F.lit(0))
    if wanted:
        index = F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col("value")) - 1
    marked = entries.withColumn("_keep", _kept(remove)).withColumn(
        "_shift", F.when(~F.col("_keep") & (index >= 0), F.col("pos") - index)
    )
    sums = marked.groupBy("doc_id").agg(
        F.count_if("_keep").alias("n_kept"),
        F.count_if(~F.col("_keep")).alias("n_dropped"),
        F.max(F.when(F.col("_keep"), F.col("pos"))).alias("_last_kept"),
        F.count("_shift").alias("_placed"),
        F.min("_shift").alias("_low"),
        F.max("_shift").alias("_high"),
    )
    zero = F.lit(0)
    joined = docs.join(sums, "doc_id", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("n_kept", "n_dropped", "_placed")}
    )
    same_list = (
        (F.col("n_dropped") == len(wanted))
        & (F.col("_placed") == len(wanted))
        & (F.coalesce("_last_kept", F.lit(-1)) == F.col("n_kept") - 1)
        & (
            F.lit(not wanted)
            | ((F.col("_low") == F.col("n_kept")) & (F.col("_high") == F.col("n_kept")))
        )
    )
    new_skills = F.array(*[F.lit(s) for s in skills]) if skills else F.col("skills")
    return joined.select(
        "doc_id",
        F.col("n_kept").cast("bigint").alias("n_kept"),
        F.col("n_dropped").cast("bigint").alias("n_dropped"),
        (same_list & new_skills.eqNullSafe(F.col("skills"))).alias("unchanged"),
        new_skills.alias("skills"),
    )


def route(
    requests: DataFrame, hosts: DataFrame, pages: DataFrame, redirects: DataFrame, url: str = "url"
) -> DataFrame:
    """Answer to each request: ``status`` and redirect ``location``.

    403 for a host that is not permitted, 200 for a page, 302 with the target
    for a redirect, else 404.  The path loses its trailing slashes first.
    """
    key = strip_trailing_slashes(F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit("")))
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    # One host or path may be asked for by a third of all requests.
    h = hosts.select(F.col("host").alias("_host"), F.lit(True).alias("_permitted"))
    p = pages.select(F.col("path").alias("_key"), F.lit(True).alias("_page"))
    r = redirects.select(F.col("path").alias("_key"), F.col("target").alias("_target"))
    status = (
        F.when(F.col("_permitted").isNull(), 403)
        .when(F.col("_page"), 200)
        .when(F.coalesce("_target", F.lit("")) != "", 302)
        .otherwise(404)
    )
    answers = p.join(r, "_key", "full_outer")
    out = lookup_join(requests.withColumns({"_host": host, "_key": key}), h, ["_host"])
    out = lookup_join(out, answers, ["_key"]).withColumn("status", status)
    return out.withColumn("location", F.when(F.col("status") == 302, F.col("_target"))).drop(
        "_host", "_key", "_permitted", "_page", "_target"
    )

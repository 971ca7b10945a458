"""URL filters: stated rules, then boosted trees on lexical features, in DataFrame functions only.

Rules give a verdict for a host, its subdomains and a path prefix; the longest that fits
wins.  Other URLs are judged by gradient-boosted trees over length, depth, digits,
entropy, parameters and suffix statistics.  The trees learn from a bounded sample of
labelled URLs: bad ones are those whose host has a label, or a part of one between hyphens, that is a
word of a stated list (digits may follow it), good ones all others but those that a rule blocks.
Suffix statistics count all labelled URLs, not the sample, and every suffix has its own.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.skew import lookup_join
from buildgraph.functions.storage import materialize
from buildgraph.llm.boosting import bounded_sample, fit

#: (verdict, host and path prefix).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Words in a host that label it as unwanted for training.
UNWANTED = ("spam", "pills", "adult", "ads", "bets", "casino")
#: Labelled rows that train the trees.
TRAIN_ROWS = 20_000
#: Weight, in URLs, of the mean in the statistic of a suffix.
PRIOR = 10
THRESHOLD = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """(verdict, rule) of the longest rule that fits; null if none does."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def is_unwanted(host: Column) -> Column:
    """Whether a host has a word of the list between dots, hyphens and its ends."""
    return host.rlike(f"(^|[.-])({'|'.join(UNWANTED)})[0-9]*($|[.-])")


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers that describe how a URL looks."""
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    letters = F.split(host, "")
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.size(letters)
    entropy = F.aggregate(F.transform(F.array_distinct(letters), share), F.lit(0.0), lambda a, p: a - p * F.log2(p))
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    return {
        "length": F.length(url),
        "host_length": F.length(host),
        "depth": F.length(F.regexp_replace(path, "[^/]", "")),
        "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)),
        "path_digits": F.length(F.regexp_replace(path, "[^0-9]", "")),
        "entropy": F.when(F.length(host) > 0, entropy).otherwise(0.0),
        "labels": F.length(F.regexp_replace(host, "[^.]", "")) + F.when(host != "", 1).otherwise(0),
        "hyphens": F.length(F.regexp_replace(host, "[^-]", "")),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "fragment": url.contains("#").cast("int"),
        "secure": url.startswith("https:").cast("int"),
    }


def suffix_rates(labelled: DataFrame) -> tuple[DataFrame, float]:
    """((_suffix, _f_suffix_rate), mean): shrunk share of unwanted URLs by last host label, and over all."""
    rows = materialize(labelled.groupBy("_suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("y")), "suffixes")
    total = rows.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    mean = total["y"] / total["n"] if total["n"] else 0.0
    rate = (F.col("y") + F.lit(PRIOR * mean)) / (F.col("n") + PRIOR)
    return rows.select("_suffix", rate.alias("_f_suffix_rate")), mean


def judged(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """``pages`` (key, url) with host, path, rule, verdict and probability (that the URL is unwanted).

    A null URL, or one without ://, has no host; no rule fits and it is blocked.  Repeated rows
    get the same verdict, whatever their key, also null.  URLs of any length are judged whole; an empty table
    gives an empty one.  Other columns, whatever their names, are not read.
    """
    rows = pages.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{url}`").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumns(
        {
            "_rule": rule_for(F.col("host"), F.col("path")),
            "_suffix": F.substring_index("host", ".", -1),
            **{f"_f_{k}": v.cast("double") for k, v in lexical_features(F.coalesce("_url", F.lit("")), F.col("host"), F.col("path")).items()},
        }
    )
    names = [c for c in rows.columns if c.startswith("_f_")]
    # A block rule is about a part of a site; it says nothing about how bad URLs look.
    blocked = F.coalesce(F.col("_rule.verdict") == "block", F.lit(False))
    label = F.when(is_unwanted(F.col("host")), 1).when(~blocked, 0)
    labelled = rows.withColumn("_y", label).where("_y is not null and host != ''")
    rates, mean = suffix_rates(labelled)
    # One suffix may have most of the URLs.
    rows = lookup_join(rows, rates, ["_suffix"], "left", spread=["_url"]).fillna(mean, ["_f_suffix_rate"])
    sample = bounded_sample(labelled, "_url", TRAIN_ROWS).join(rates, "_suffix", "left")
    probability = fit(sample, [*names, "_f_suffix_rate"], "_y")
    scored = rows.withColumn("probability", F.expr(probability))
    own = F.when((F.col("host") == "") | (F.col("probability") >= THRESHOLD), "block").otherwise("allow")
    return scored.select(
        F.col("_key").alias(key), F.col("_url").alias("url"), "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), own).alias("verdict"), "probability",
    )


def op8(pages: DataFrame) -> DataFrame:
    """The contract's digest columns."""
    return judged(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")

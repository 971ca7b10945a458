"""Quality rules with verdicts of hosts, in DataFrame functions only.

Base rules judge a document by itself.  The method's rules (share of
symbols, of shouted letters, of repeated lines, and word length) have two limits: a
strict and a loose one.  Per host and rule, the rate of documents over the strict limit
is shrunk towards the rate of all hosts with an empirical beta prior, so a host of few
documents is not condemned by one.  Where the shrunk rate is high, the host is
under suspicion for that rule and the strict limit applies to its documents,
elsewhere the loose one.  A document that breaks no limit stays, whatever its host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.storage import materialize
from buildgraph.llm.tables import stored

SPACE = "[ \\t-\\r]+"
#: Rule: (strict limit, loose limit).
RULES = {"symbols": (0.1, 0.5), "shouted": (0.3, 0.7), "repeated": (0.2, 0.5), "long_words": (12.0, 20.0)}
#: Shrunk failure rate from which a host is under suspicion.
SUSPICIOUS = 0.5
#: Least weight of the prior, in documents, so that one document condemns no host.
LEAST_STRENGTH = 10.0


def words_of(text: Column) -> Column:
    """Words separated by white space (0x20, 0x09-0x0D); none for null."""
    trimmed = F.trim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))


def rule_counts(docs: DataFrame, text: str, out: str = "_q") -> DataFrame:
    """``docs`` with one struct column of counts.

    A null or empty text has no words and zero counts.  Windows of five words are
    compared by a 64-bit hash within the text; only texts in which one occurs twice
    are sorted.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    d = docs.withColumns({f"{out}_w": words_of(F.col(text)), f"{out}_l": lines})
    w = f"{out}_w"
    five = F.expr(
        f"IF(size({w}) < 5, cast(array() as array<bigint>), transform(sequence(0, size({w}) - 5), "
        f"i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2], {w}[i + 3], {w}[i + 4])))"
    )
    d = d.withColumn(f"{out}_h", five)
    h = F.col(f"{out}_h")
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    none = F.array().cast("array<struct<x:bigint,i:int>>")
    d = d.withColumn(f"{out}_s", F.when(F.size(F.array_distinct(h)) < F.size(h), placed).otherwise(none))
    s = f"{out}_s"
    again = F.expr(
        f"array_sort(transform(filter({s}, (v, n) -> (n > 0 and v.x = {s}[n - 1].x) or "
        f"(n + 1 < size({s}) and v.x = {s}[n + 1].x)), v -> v.i))"
    )
    d = d.withColumn(f"{out}_p", again)
    p = f"{out}_p"
    covered = F.expr(f"aggregate(transform({p}, (v, n) -> IF(n + 1 < size({p}), least({p}[n + 1] - v, 5), 5)), 0L, (a, b) -> a + b)")
    raw = F.coalesce(F.col(text), F.lit(""))
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(raw, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(f"{out}_l") - F.size(F.array_distinct(f"{out}_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(f"{out}_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace(raw, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )
    return d.withColumn(out, counts).drop(w, f"{out}_l", f"{out}_h", s, p)


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])


def rule_values(q: Column) -> dict[str, Column]:
    """What each of the method's rules compares with its limits; 0 for a text without words."""
    share = {
        "symbols": q["n_symbols"] / q["n_words"],
        "shouted": q["n_capitals"] / q["word_chars"],
        "repeated": q["n_dup_lines"] / q["n_lines"],
        "long_words": q["word_chars"] / q["n_words"],
    }
    return {k: F.when(q["n_words"] > 0, v).otherwise(F.lit(0.0)) for k, v in share.items()}


def host_rates(counted: DataFrame, host: str, q: str = "_q") -> DataFrame:
    """(_host, documents, <rule>_failed): documents over the strict limit."""
    values = rule_values(F.col(q))
    return counted.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.sum((values[r] > strict).cast("long")).alias(f"{r}_failed") for r, (strict, _) in RULES.items()],
    )


def beta_priors(rates: DataFrame) -> dict[str, tuple[float, float]]:
    """Empirical prior (alpha, beta) of each rule's failure rate, by the method of moments.

    One row of sums reaches the driver.
    """
    n = F.col("documents")
    sums = [F.sum(n).alias("n"), F.count(F.lit(1)).alias("hosts")]
    for r in RULES:
        f = F.col(f"{r}_failed")
        sums += [F.sum(f).alias(f"{r}_f"), F.sum(f * f / n).alias(f"{r}_ff")]
    row = rates.agg(*sums).first()
    priors = {}
    for r in RULES:
        if not row["n"]:
            priors[r] = (1.0, 1.0)
            continue
        mean = min(max(row[f"{r}_f"] / row["n"], 1e-6), 1 - 1e-6)
        spread = max(row[f"{r}_ff"] / row["n"] - mean * mean, 0.0)  # weighted variance of the rates
        noise = mean * (1 - mean) * row["hosts"] / row["n"]  # what counting alone gives
        between = max(spread - noise, 1e-9)
        strength = min(max(mean * (1 - mean) / between - 1, LEAST_STRENGTH), 1e4)
        priors[r] = (mean * strength, (1 - mean) * strength)
    return priors


def host_verdicts(rates: DataFrame) -> DataFrame:
    """(_host, _suspicious: map of rule to boolean) from the shrunk rates."""
    priors = beta_priors(rates)
    flags = []
    for r in RULES:
        a, b = priors[r]
        shrunk = (F.col(f"{r}_failed") + F.lit(a)) / (F.col("documents") + F.lit(a + b))
        flags.append((shrunk > SUSPICIOUS).alias(r))
    return rates.select("_host", F.struct(*flags).alias("_suspicious"))


def judge(docs: DataFrame, text: str, host: str, keep: list[str], counts: str = "_q", kept: str = "_kept") -> DataFrame:
    """Columns ``keep`` of ``docs`` with the counts struct and a boolean verdict.

    Rows are counted once and stored (only ``keep``, the host and the counts); host
    verdicts come back through a table of one row per host.  A null host is a
    host of its own.  Repeated rows count each and get the same verdict.  The columns to keep travel as one
    value, so their names are free, except for those of the two added ones.
    """
    named = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in keep]).alias("_row"),
        F.col(f"`{text}`").alias("_text"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{host}`").cast("string")), F.lit("null")).alias("_host"),
    )
    counted = stored(rule_counts(named, "_text", "_q").select("_row", "_host", "_q"), "quality")
    verdicts = materialize(host_verdicts(host_rates(counted, "_host", "_q")), "hosts")
    joined = counted.join(verdicts, "_host", "left")
    values = rule_values(F.col("_q"))
    broken = F.lit(False)
    for r, (strict, loose) in RULES.items():
        limit = F.when(F.col("_suspicious")[r], strict).otherwise(loose)
        broken = broken | (values[r] > limit)
    verdict = ~(base_failed(F.col("_q")) | broken)
    return joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep], F.col("_q").alias(counts), verdict.alias(kept))


def op7(docs: DataFrame) -> DataFrame:
    """The contract's digest columns."""
    out = judge(docs.select("doc_id", "text", "source"), "text", "source", ["doc_id"])
    q = F.col("_q")
    return out.select(
        "doc_id",
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(q).alias("base_failed"),
        F.col("_kept").alias("kept"),
    )

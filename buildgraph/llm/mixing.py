"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic).  Expected tokens of the cells are
raked in turn to the targets of each of the three until they fit all, and no cell
gets more than it has: a cell is min(tokens, weight), and the factor of a value is the one with which
its cells reach the target after that cut.  A document of a cell is sampled with
probability expected tokens / tokens.  A value that has fewer tokens than its target
asks for is taken whole, and the others of its dimension share the rest by their targets;
``reachable`` states both shares.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.storage import materialize
from buildgraph.llm.quality import words_of

#: Wanted shares of tokens by language; the others keep the share they have.
LANGUAGES = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
#: Sources and topics get their share to this power, which lifts small ones.
SOURCE_POWER = 0.7
TOPIC_POWER = 0.8
KEEP_SHARE = 0.5
ROUNDS = 20
#: Rounds with the bound that no cell gives more than it has.
BOUND_ROUNDS = 500
#: Cells up to which the driver rakes.
FEW_CELLS = 20_000
TOLERANCE = 1e-4
SEED = 20240607
DIMENSIONS = ("source", "lang", "topic")


def topic_of(text: Column, n_tokens: Column) -> Column:
    """A coarse topic by the form of a text: tables, contact data, then by length."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("@") | text.rlike("\\+[0-9]"), "contact")
        .when(n_tokens >= 1000, "long")
        .when(n_tokens >= 100, "article")
        .otherwise("note")
    )


def value_key(column: Column) -> Column:
    """A value as text that keeps null apart from every value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def token_cells(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens) per cell."""
    return docs.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def tempered_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, target): the shares raised to a power and scaled to one."""
    shares = cells.groupBy(dimension).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("lifted")).where("lifted > 0")
    total = shares.agg(F.sum("lifted")).first()[0] or 1.0
    return shares.select(dimension, (F.col("lifted") / total).alias("target"))


def stated_targets(cells: DataFrame, dimension: str, wanted: dict[str, float]) -> DataFrame:
    """(value, target): stated shares of the values there are; other values keep their share."""
    totals = materialize(cells.groupBy(dimension).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "mix-totals")
    share = F.lit(None).cast("double")
    for value, target in wanted.items():
        share = F.when(F.col(dimension) == f"={value}", F.lit(float(target))).otherwise(share)
    told = totals.withColumn("share", share)
    row = told.agg(
        F.sum("tokens").alias("all"), F.sum(F.when(F.col("share").isNull(), F.col("tokens"))).alias("rest"), F.sum("share").alias("stated")
    ).first()
    rest, stated = (row["rest"] or 0.0) / (row["all"] or 1.0), row["stated"] or 1.0
    return told.select(
        dimension,
        F.coalesce(F.col("share") * F.lit((1 - rest) / stated), F.col("tokens") / F.lit(row["all"] or 1.0)).alias("target"),
    )


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``weight``: shares whose marginals are the targets.

    A round rakes to each dimension once and is written to the shared folder.  Ends when a round
    moves no cell by more than ``tolerance`` of its weight, or after ``rounds``.
    Cells without tokens have weight 0.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1.0
    now = materialize(cells.withColumn("weight", F.col("tokens") / F.lit(total)), "mix-cells")
    for _ in range(rounds):
        after = now.withColumn("_was", F.col("weight"))
        for dimension, target in targets.items():
            sums = after.groupBy(dimension).agg(F.sum("weight").alias("_sum"))
            factor = sums.join(target, dimension).select(dimension, (F.col("target") / F.col("_sum")).alias("_factor"))
            after = after.join(factor, dimension, "left").withColumn("weight", F.col("weight") * F.coalesce("_factor", F.lit(1.0))).drop("_factor")
        after = materialize(after, "mix-cells")
        moved = after.agg(F.max(F.when(F.col("_was") > 0, F.abs(F.col("weight") / F.col("_was") - 1)))).first()[0] or 0.0
        now = after.drop("_was")
        if moved <= tolerance:
            break
    return now


def reachable(cells: DataFrame, dimension: str, targets: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """(value, target, reached): the share of the sample a value can have; less than its target if it has too few tokens.

    Values that are taken whole leave more to the others, in proportion to their targets.
    """
    had = cells.groupBy(dimension).agg(F.sum("tokens").alias("tokens"))
    had = materialize(had.join(targets, dimension), "mix-reach")
    wanted = keep_share * (had.agg(F.sum("tokens")).first()[0] or 0.0)
    scale, full = wanted, -1
    while True:
        whole = F.col("tokens") < F.col("target") * F.lit(scale)
        row = had.agg(F.count(F.when(whole, 1)), F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole, F.col("target")))).first()
        if row[0] == full or not row[2]:
            break
        full, scale = row[0], (wanted - (row[1] or 0.0)) / row[2]
    return had.select(dimension, "target", (F.least("tokens", F.col("target") * F.lit(scale)) / F.lit(wanted or 1.0)).alias("reached"))


def raked_here(cells: DataFrame, targets: dict[str, DataFrame], keep_share: float, rounds: int, tolerance: float) -> DataFrame:
    """``raked_within`` in arrays on the driver."""
    rows = cells.orderBy(*DIMENSIONS).collect()
    tokens = np.array([r.tokens or 0.0 for r in rows])
    wanted, weight, dims = keep_share * tokens.sum(), tokens * keep_share, []
    for dimension, target in targets.items():
        reached = {r[0]: r.reached for r in target.select(dimension, "reached").collect()}
        at = {value: i for i, value in enumerate(reached)}
        own = np.array([at.get(r[dimension], -1) for r in rows], dtype=int)
        dims.append((own[own >= 0], np.flatnonzero(own >= 0), np.array(list(reached.values())) * wanted))
    for _ in range(rounds):
        off = 0.0
        for own, cell, goal in dims:
            if not len(cell):
                continue
            w, t = weight[cell], tokens[cell]
            has = np.bincount(own, np.minimum(w, t), len(goal))
            whole = np.bincount(own, np.where(w >= t, t, 0.0), len(goal))
            rest = has - whole
            off = max(off, np.abs(has / goal - 1).max())
            step = np.where(rest > 0, (goal - whole) / np.where(rest > 0, rest, 1.0), np.where(has > goal, 0.0, 1.0))
            weight[cell] *= np.maximum(step, goal / has / 2)[own]
        if off <= tolerance:
            break
    columns = {c: [r[c] for r in rows] for c in DIMENSIONS} | {"tokens": tokens.tolist(), "weight": weight.tolist()}
    made = list(zip(*columns.values(), strict=True))
    return materialize(cells.sparkSession.createDataFrame(made, "source string, lang string, topic string, tokens double, weight double"), "mix-cells")


def raked_within(cells: DataFrame, targets: dict[str, DataFrame], keep_share: float = KEEP_SHARE, rounds: int = BOUND_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``weight``: min(tokens, weight) is the expected tokens of a cell and has the ``reached`` shares.

    A factor is one Newton step towards the root of the cut sums.  Ends when every value
    is within ``tolerance`` of its target, or after ``rounds`` if the targets contradict each other.
    Up to ``FEW_CELLS`` cells are raked on the driver, more in stored tables, by the same rule.
    """
    if cells.limit(FEW_CELLS + 1).count() <= FEW_CELLS:
        return raked_here(cells, targets, keep_share, rounds, tolerance)
    wanted = keep_share * (cells.agg(F.sum("tokens")).first()[0] or 0.0)
    now = materialize(cells.withColumn("weight", F.col("tokens") * F.lit(keep_share)), "mix-cells")
    cut = F.least("tokens", "weight")
    for _ in range(rounds):
        after, off = now, []
        for dimension, target in targets.items():
            sums = after.groupBy(dimension).agg(
                F.sum(cut).alias("_has"), F.sum(F.when(F.col("weight") >= F.col("tokens"), F.col("tokens")).otherwise(0.0)).alias("_whole")
            )
            goal, rest = F.col("reached") * F.lit(wanted), F.col("_has") - F.col("_whole")
            step = F.when(rest > 0, (goal - F.col("_whole")) / rest).otherwise(F.when(F.col("_has") > goal, 0.0).otherwise(1.0))
            factor = F.greatest(step, goal / F.col("_has") / 2)
            far = F.abs(F.col("_has") / goal - 1).alias(f"_off_{dimension}")
            found = sums.join(target, dimension).where("_has > 0").select(dimension, factor.alias("_factor"), far)
            after = after.join(found, dimension, "left").withColumn("weight", F.col("weight") * F.coalesce("_factor", F.lit(1.0))).drop("_factor")
            off.append(F.coalesce(F.max(f"_off_{dimension}"), F.lit(0.0)))
        after = materialize(after, "mix-cells")
        moved = after.agg(*off).first()
        now = after.select(*cells.columns, "weight")
        if max(moved) <= tolerance:
            break
    return now


def probabilities(cells: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """(source, lang, topic, weight, probability) with the wanted share of tokens in expectation.

    The scale is found on a grid that is refined three times; each pass is one aggregate.
    """
    sums = cells.agg(F.sum("tokens"), F.max(F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))), F.min(F.when(F.col("weight") > 0, F.col("weight") / F.col("tokens")))).first()
    total, high, low = (x or 1.0 for x in sums)
    wanted = keep_share * total
    below, above = keep_share / high / 1.001, 1.001 / low
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    for _ in range(3):
        grid = [below * (above / below) ** (i / 40) for i in range(41)]
        row = cells.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), ratio * F.lit(c))).alias(f"c{i}") for i, c in enumerate(grid)]).first()
        over = next((i for i in range(41) if (row[i] or 0.0) >= wanted), 40)
        below, above = grid[max(over - 1, 0)], grid[over]
    return cells.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), ratio * F.lit(above)).alias("probability"))


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends only on the id."""
    return F.xxhash64(F.lit(seed), doc_id).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def sampling_table(measured: DataFrame, languages: dict[str, float] | None = None, keep_share: float = KEEP_SHARE) -> DataFrame:
    """(source, lang, topic, weight, probability) of ``measured`` (source, lang, topic as keys, n_tokens); weight is the share of the sample."""
    cells = materialize(token_cells(measured), "mix-start")
    targets = {
        "source": materialize(tempered_targets(cells, "source", SOURCE_POWER), "mix-target"),
        "topic": materialize(tempered_targets(cells, "topic", TOPIC_POWER), "mix-target"),
        "lang": materialize(stated_targets(cells, "lang", languages or LANGUAGES), "mix-target"),
    }
    bounds = {d: materialize(reachable(cells, d, t, keep_share), "mix-target") for d, t in targets.items()}
    rates = materialize(probabilities(raked_within(cells, bounds, keep_share), keep_share).join(cells, list(DIMENSIONS)), "mix-rates")
    share = F.col("probability") * F.col("tokens")
    total = rates.agg(F.sum(share)).first()[0] or 1.0
    return rates.select(*DIMENSIONS, (share / F.lit(total)).alias("weight"), "probability")


def mixed(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """Columns ``keep`` of ``docs`` with _topic, _n_tokens, _weight, _probability and _sampled.

    Tokens are words here.  Null sources and languages are values of their own.
    Documents without tokens have probability 0.  Rows of the same id share their fate.
    """
    n = F.size(words_of(F.col(text))).cast("long")
    named = docs.withColumn("_n_tokens", n)
    named = named.withColumn("_topic", topic_of(F.coalesce(F.col(text), F.lit("")), F.col("_n_tokens")))
    keys = [value_key(F.col(c)).alias(d) for c, d in ((source, "source"), (lang, "lang"), ("_topic", "topic"))]
    rates = sampling_table(named.select(*keys, F.col("_n_tokens").alias("n_tokens")))
    rates = rates.select(*[F.col(d).alias(f"_by_{d}") for d in DIMENSIONS], F.col("weight").alias("_weight"), F.col("probability").alias("_probability"))
    tagged = named.withColumns({f"_by_{d}": value_key(F.col(c)) for c, d in ((source, "source"), (lang, "lang"), ("_topic", "topic"))})
    joined = tagged.select(*keep, F.col(doc_id).alias("_id"), "_topic", "_n_tokens", *[f"_by_{d}" for d in DIMENSIONS])
    joined = joined.join(rates, [f"_by_{d}" for d in DIMENSIONS], "left")
    return joined.withColumn("_sampled", uniform(F.col("_id")) < F.col("_probability")).drop("_id", *[f"_by_{d}" for d in DIMENSIONS])


def op10(docs: DataFrame) -> DataFrame:
    """Every document with its cell, sampling probability and whether it is in the sample."""
    out = mixed(docs.select("doc_id", "text", "source", "lang"), ["doc_id", "source", "lang"])
    return out.select(
        "doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_n_tokens").alias("n_tokens"),
        F.round("_probability", 6).alias("probability"), F.col("_sampled").alias("sampled"),
    )

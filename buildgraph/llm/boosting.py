"""Gradient-boosted trees as plain column expressions.

Trees are fitted by Spark's own learner and turned into nested
CASE expressions, so scoring is part of the same projection as the features.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLIT = re.compile(r"^( *)If \(feature (\d+) <= (\S+)\)$")
LEAF = re.compile(r"^( *)Predict: (\S+)$")


def tree_sql(text: str, names: list[str]) -> str:
    """A printed regression tree as SQL over the named features."""
    lines = [x for x in text.split("\n")[1:] if x.strip()]

    def node(at: int) -> tuple[str, int]:
        leaf = LEAF.match(lines[at])
        if leaf:
            return f"{float(leaf[2])!r}D", at + 1
        split = SPLIT.match(lines[at])
        left, after = node(at + 1)
        right, after = node(after + 1)  # the line between is the matching Else
        return f"IF({names[int(split[2])]} <= {float(split[3])!r}D, {left}, {right})", after

    return node(0)[0]


def fit(rows: DataFrame, features: list[str], label: str, prefix: str = "", trees: int = 20, depth: int = 3) -> str:
    """SQL for the probability of label 1, over features written as ``prefix`` plus name.

    Spark keeps ``rows`` over its executors and reads them once per level of a tree.  Without rows, or with one label only, the probability is
    the share of ones (0 without rows).
    """
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("ones")).first()
    if not row["n"] or row["ones"] in (0, row["n"]):
        return f"{float(row['ones'] or 0) / max(row['n'], 1)!r}D"
    table = VectorAssembler(inputCols=features, outputCol="_v").transform(rows.select(*[F.col(c).cast("double") for c in features], F.col(label).cast("double").alias("_y")))
    model = GBTClassifier(featuresCol="_v", labelCol="_y", maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=64, seed=7, minInstancesPerNode=5).fit(table)
    names = [prefix + c for c in features]
    terms = [f"{w!r}D * {tree_sql(t.toDebugString, names)}" for w, t in zip(model.treeWeights, model.trees, strict=True)]
    return f"(1D / (1D + exp(-2D * ({' + '.join(terms)}))))"


def calibrated_threshold(scored: DataFrame, score: str, label: str, precision: float) -> float:
    """The least threshold, from a half up, from which held-out precision reaches the goal; above 1 if none does.

    One aggregate row reaches the driver.
    """
    steps = [i / 100 for i in range(50, 100)]
    sums = []
    for i, t in enumerate(steps):
        chosen = F.when(F.col(score) >= t, 1)
        sums += [F.count(chosen).alias(f"n{i}"), F.sum(F.when(F.col(score) >= t, F.col(label))).alias(f"y{i}")]
    row = scored.agg(*sums).first()
    for i, t in enumerate(steps):
        if row[f"n{i}"] and (row[f"y{i}"] or 0) / row[f"n{i}"] >= precision:
            return t
    return math.nextafter(1.0, 2.0)


def hash_limit(at_most: int, n: int) -> int:
    """The value below which about ``at_most`` of ``n`` signed 64-bit hashes lie.

    A limit of 64 bits keeps its resolution for any table: among 10^12 rows one hash in 5 x 10^7 is
    chosen for 20,000, with a rounding error below 10^-11 of that.
    """
    return min((at_most << 64) // max(n, 1), (1 << 64) - 1) - (1 << 63)


def bounded_sample(rows: DataFrame, key: str, at_most: int, name: str = "sample", n: int | None = None) -> DataFrame:
    """About ``at_most`` rows, chosen by a hash of the key; all if there are no more.

    ``n``: the number of rows, if it is known.
    """
    n = rows.count() if n is None else n
    if n <= at_most:
        return rows
    return rows.where(F.xxhash64(F.lit(name), F.col(key)) < F.lit(hash_limit(at_most, n)))

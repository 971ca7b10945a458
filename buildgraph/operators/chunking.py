"""Numbering rows into chunks and keeping the newest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildgraph.functions.ordered import number_rows

CHUNK_ROWS = 192


def chunk_number(position: str | Column, n: int = CHUNK_ROWS, offset: str = "reference") -> Column:
    """Chunk of a 1-based position.

    ``reference``: position // n + 1, so the first chunk has n - 1 rows;
    ``even``: every chunk but the last has n rows.
    """
    p = F.col(position) if isinstance(position, str) else position
    if offset == "reference":
        return (F.floor(p / n) + 1).cast("bigint")
    if offset == "even":
        return (F.floor((p - 1) / n) + 1).cast("bigint")
    raise ValueError("offset must be 'reference' or 'even'")


def chunk(
    df: DataFrame,
    order: Sequence[str],
    n: int = CHUNK_ROWS,
    name: str = "build",
    offset: str = "reference",
) -> DataFrame:
    """Number all rows in ``order`` and cut them into chunks of ``n``.

    Adds ``position``, ``chunk`` and ``chunk_file``.  The numbering is global
    but runs range by range, without an unpartitioned window.
    """
    numbered = number_rows(df, [], order)
    numbered = numbered.withColumn("chunk", chunk_number("position", n, offset))
    return numbered.withColumn(
        "chunk_file", F.concat(F.lit(f"{name}-chunk-"), "chunk", F.lit(".json"))
    )


#: Commits per repository up to which they are ranked in a window.
RANKED = 1000


def keep_set(
    commits: DataFrame, n: int = 5, mode: str = "ancestry", repo: str = "repo"
) -> DataFrame:
    """Commits to keep per repository: HEAD and n - 1 more.

    ``ancestry`` keeps the newest n (``commit_time``, then ``position``);
    ``parents`` keeps HEAD and its first n - 1 direct parents (``is_head``,
    ``parent_pos``, 0-based, null for other commits).
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if mode == "parents":
        return commits.filter(F.col("is_head") | (F.col("parent_pos") < n - 1))
    if mode != "ancestry":
        raise ValueError("mode must be 'ancestry' or 'parents'")
    if n > RANKED:
        # Spark keeps the first n of each task before the exchange; for a large n that is no help.
        late = commits.withColumns({"_t": -F.col("commit_time"), "_p": -F.col("position")})
        late = late.withColumns({"_no_t": F.col("_t").isNull(), "_no_p": F.col("_p").isNull()})
        order = ["_no_t", "_t", "_no_p", "_p"]
        numbered = number_rows(late, [repo], order, "_rn")
        return numbered.filter(F.col("_rn") <= n).drop("_rn", *order)
    newest = Window.partitionBy(repo).orderBy(
        F.col("commit_time").desc(), F.col("position").desc()
    )
    return (
        commits.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")
    )


def newest(candidates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Candidate with the largest commit time; of equal times the last by ``pos``.

    An unreadable (null) time sorts lowest.  ``ambiguous`` tells whether there
    was more than one candidate.
    """
    place = F.struct(F.coalesce("commit_time", F.lit(-(1 << 63))), "pos")
    return candidates.groupBy(*by).agg(
        F.max_by("sha", place).alias("sha"),
        (F.count(F.lit(1)) > 1).alias("ambiguous"),
    )


def first_match(flat: DataFrame, wanted: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    """Download address of the first artifact, in document order, per wanted commit.

    ``flat`` comes from ``flatten_artifacts``; ``wanted`` lists commits.
    """
    hits = flat.filter(F.col("path") == path).join(
        wanted.select("commit").distinct(), "commit", "left_semi"
    )
    place = F.struct("build_pos", "job_pos", "artifact_pos")
    return hits.groupBy(*by, "commit").agg(F.min_by("download_url", place).alias("download_url"))


def ordered_distinct(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key in ``order``; a partial aggregate, not a window."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])

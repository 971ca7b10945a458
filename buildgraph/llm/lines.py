"""Repeated line runs, found by prefix doubling over line numbers, in DataFrame functions only.

The lines of all documents form one sequence of line ids.  Ranks of single lines
come from a distributed sort of the distinct ids; ranks of two lines from a sort of
the distinct rank pairs, and so on, doubling.  Suffixes of equal rank at depth m
are the intervals of the suffix array whose longest common prefix is at least m lines.
A line that occurs once in the corpus cannot be in a repeated run; it ends runs and
is left out before the first sort.

A repeated run counts if it has at least ``min_lines`` lines, or at least ``min_words``
words in fewer.  In each interval the suffix that starts first, by (doc_id,
content, line), stays; the lines of all others are deleted.  Overlapping runs add up to
the maximal ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildgraph.functions.ordered import number_rows
from buildgraph.functions.storage import materialize
from buildgraph.llm.key_filter import key_filter, split_by_filter

MIN_LINES = 4
MIN_WORDS = 50


def row_key(doc_id: Column, text: Column) -> Column:
    """Key of a row: rows equal in id and text are one document."""
    return F.xxhash64(doc_id, text)


def line_rows(docs: DataFrame) -> DataFrame:
    """(k, doc_id, pos, line, h1, h2, words): lines with a word, numbered within their document.

    ``line`` is the place among all lines.  Lines compare without white space at their ends.
    """
    lines = F.filter(
        F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), F.trim(x, F.lit(" \t\x0b\f\r")).alias("t"))),
        lambda s: F.length(s["t"]) > 0,
    )
    d = docs.where("text is not null").select("k", "doc_id", F.posexplode(lines).alias("pos", "s"))
    return d.select(
        "k",
        "doc_id",
        "pos",
        F.col("s.line").alias("line"),
        F.xxhash64("s.t").alias("h1"),
        F.xxhash64(F.lit("second"), "s.t").alias("h2"),
        F.size(F.split("s.t", "[ \\t-\\r]+")).alias("words"),
    )


def rank_table(distinct_keys: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Distinct keys with their place in order, by a distributed sort."""
    return materialize(number_rows(distinct_keys, [], keys, out), "line-ranks")


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, gone: line places to delete) of ``docs`` (k, doc_id, text).

    A null doc_id counts as the smallest; null and empty texts have no lines.
    """
    rows = materialize(line_rows(docs), "line-rows")
    repeated = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    ranked = rank_table(repeated, ["h1", "h2"], "r1")
    kept = rows.join(ranked, ["h1", "h2"]).select("k", "doc_id", "pos", "line", "words", "r1")
    kept = kept.repartition("k").dropDuplicates(["k", "pos"])
    here = Window.partitionBy("k").orderBy("pos")

    def ahead(column: str, by: int) -> Column:
        """The value of the suffix ``by`` lines on, if no line between was left out."""
        return F.when(F.lead("pos", by).over(here) == F.col("pos") + by, F.lead(column, by).over(here))

    level = materialize(kept.withColumns({"next": ahead("r1", 1), "w1": F.col("words")}), "line-level")
    ranks = {1: "r1"}
    depth = 1
    while depth * 2 <= min_lines:
        now, then = f"r{depth}", f"r{depth * 2}"
        shared = level.where("next is not null").groupBy(now, "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(now, "next")
        numbers = rank_table(shared, [now, "next"], then)
        depth *= 2
        ranks[depth] = then
        level = level.join(numbers, [now, "next"], "left").drop("next")
        step = depth if depth * 2 <= min_lines else 0
        level = materialize(level.withColumn("next", ahead(then, step)) if step else level, "line-level")
    level = level.withColumns({f"w{m}": sum_ahead(m, here) for m in range(2, min_lines + 1)})
    windows = []
    for m in range(1, min_lines + 1):
        power = 1 << (m.bit_length() - 1)
        first = F.col(ranks[power])
        second = first if m == power else ahead(ranks[power], m - power)
        long_enough = F.lit(m >= min_lines) | (F.col(f"w{m}") >= min_words)
        windows.append(F.when(long_enough & first.isNotNull() & second.isNotNull(), F.struct(F.lit(m).alias("m"), first.alias("a"), second.alias("b"))))
    suffixes = level.select("k", "doc_id", "pos", "line", F.array_compact(F.array(*windows)).alias("windows"))
    suffixes = materialize(suffixes.select("k", "doc_id", "pos", F.explode("windows").alias("w")).select("k", "doc_id", "pos", "w.*"), "line-suffixes")
    first = suffixes.groupBy("m", "a", "b").agg(F.min(F.struct("doc_id", "k", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Stored, so that an interval of very many suffixes can be split in the join.
    first = materialize(first.drop("n"), "line-first")
    copies = suffixes.join(first, ["m", "a", "b"]).where(~(F.col("first.k").eqNullSafe(F.col("k")) & (F.col("first.pos") == F.col("pos"))))
    longest = copies.groupBy("k", "pos").agg(F.max("m").alias("m"))
    places = longest.select("k", F.explode(F.expr("sequence(pos, pos + m - 1)")).alias("pos")).distinct()
    return places.join(level.select("k", "pos", "line"), ["k", "pos"]).groupBy("k").agg(F.collect_list("line").alias("gone"))


def sum_ahead(m: int, here) -> Column:
    """Words of the m lines from here, as far as they were kept."""
    return F.sum("words").over(here.rowsBetween(0, m - 1))


#: Columns that :func:`without_repeated_lines` adds.
ADDED = ("_kept_text", "_n_lines", "_n_gone")


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """``docs`` with _kept_text, _n_lines (lines with a word) and _n_gone.

    The kept text is the other lines in order; a text of which nothing is deleted stays
    as it is, also null.  Rows equal in id and text get the same result.  Texts of any length are
    whole; an empty table gives an empty one.  The row travels as one value, so columns of any
    name pass through, except that those named like the three added ones are replaced.
    """
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.col(f"`{doc_id}`").alias("_d"), F.col(f"`{text}`").alias("_t"))
    rows = rows.withColumn("_k", row_key(F.col("_d"), F.col("_t")))
    found = later_copies(rows.select(F.col("_k").alias("k"), F.col("_d").alias("doc_id"), F.col("_t").alias("text")), **limits)
    found = materialize(found.select(F.col("k").alias("_k"), F.col("gone").alias("_gone")), "line-gone")
    # Only documents that may lose a line are exchanged for the join.
    clean, hit = split_by_filter(rows, "_k", key_filter(found, "_k"))
    joined = clean.withColumn("_gone", F.lit(None).cast("array<int>")).unionByName(hit.join(found, "_k", "left"))
    lines = F.split("_t", "\n")
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone"), lambda i: F.get(F.col("_lines"), i))
    kept = F.when(F.col("_gone").isNull(), F.col("_t")).otherwise(F.array_join(rest, "\n"))
    with_word = F.size(F.filter("_lines", lambda x: x.rlike("[^ \\t-\\r]")))
    added = {
        "_kept_text": kept,
        "_n_lines": F.when(F.col("_t").isNull(), 0).otherwise(with_word).cast("long"),
        "_n_gone": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
    }
    names = [c for c in docs.columns if c not in ADDED]
    # In two steps: the row's own columns may have any of these names.
    joined = joined.withColumn("_lines", lines).select("_row", F.struct(*[v.alias(k) for k, v in added.items()]).alias("_new"))
    return joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], *[F.col(f"_new.{k}").alias(k) for k in added])


def op4(docs: DataFrame) -> DataFrame:
    """Per document: lines with a word, how many are deleted, and what is left."""
    out = without_repeated_lines(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_gone").alias("n_removed"),
        F.sha2(F.coalesce("_kept_text", F.lit("")), 256).alias("kept_sha256"),
        F.col("_kept_text").alias("kept_text"),
    )

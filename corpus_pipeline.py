"""A corpus cleaning pipeline: quality, repeated lines, near duplicates, test passages, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``docs``.  The whole row travels as one struct, so extra columns,
whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildgraph.functions.storage import materialize
from buildgraph.llm import decontamination, lines, mixing, near_duplicates, quality
from buildgraph.llm.key_filter import key_filter, split_by_filter
from buildgraph.llm.tables import stored


def packed(docs: DataFrame, *fields: str) -> DataFrame:
    """The whole row as ``_row`` beside the fields an operator needs."""
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")
    return docs.select(whole, *[docs[f].alias(f"_in_{f}") for f in fields])


def unpacked(rows: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of the packed row; a new text also sets n_chars if there is one."""
    names = rows.schema["_row"].dataType.names
    if text is None:
        return rows.select("_row.*")
    rows = rows.select("_row", text.alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`") for c in names])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their host's limits."""
    rows = packed(docs, "text", "source")
    return unpacked(quality.judge(rows, "_in_text", "_in_source", ["_row"]).where("_kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are deleted; a document of which no line is left goes."""
    out = lines.without_repeated_lines(packed(docs, "doc_id", "text"), "_in_doc_id", "_in_text")
    left = out.where((F.col("_n_gone") == 0) | (F.col("_n_gone") < F.col("_n_lines")))
    return unpacked(left, F.col("_kept_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of each group of near duplicates."""
    rows = packed(docs, "doc_id", "text").withColumn("_k", lines.row_key(F.col("_in_doc_id"), F.col("_in_text")))
    keyed = rows.select(F.col("_k").alias("k"), F.col("_in_doc_id").alias("doc_id"), F.col("_in_text").alias("text"))
    groups = stored(near_duplicates.near_duplicate_leaders(keyed), "near-verdicts")
    # Rows that lead their group and are not repeated need no exchange: the others' keys go into a filter.
    again = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    marked = materialize(groups.where("NOT leader").select("k").unionByName(again), "near-marked")
    clean, hit = split_by_filter(rows, "_k", key_filter(marked, "k"))
    leaders = groups.where("leader").select(F.col("k").alias("_k"))
    kept = hit.join(leaders.hint("merge"), "_k", "left_semi").dropDuplicates(["_k"])
    return unpacked(clean.unionByName(kept))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; a document that was nothing else goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find_contamination(packed(docs, "text"), benchmark, text="_in_text")
    gone = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    left = found.where((F.size("spans") == 0) | (gone < F.col("n_words")))
    return unpacked(left, decontamination.without_spans(F.col("_in_text"), F.col("spans")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target shares, with topic, tokens, weight and probability."""
    rows = packed(docs, "doc_id", "text", "source", "lang")
    out = mixing.mixed(rows, ["_row"], "_in_doc_id", "_in_text", "_in_source", "_in_lang").where("_sampled")
    names = out.schema["_row"].dataType.names
    added = {"topic": "_topic", "n_tokens": "_n_tokens", "weight": "_weight", "probability": "_probability"}
    return out.select("_row.*", *[F.col(v).alias(k) for k, v in added.items() if k not in names])


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: SimHash groups and suffix ranks are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

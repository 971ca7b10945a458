"""Shingle sets of texts: their names, their texts in buckets, and the exact comparison of pairs of them.

Documents of equal sets are one node, named by a 128-bit hash of the set.  One text of each node is
kept in buckets of its name, so that comparing pairs exchanges one text per pair and not the table again.
Sides of joins that grow with the corpus ask for a merge join: a small input is planned like a large one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.skew import lookup_join
from buildgraph.functions.storage import bucketed
from buildgraph.llm.arrow_words import WordHasher, chunks, lower_table, ngram_hashes, space_separated, word_spans
from buildgraph.llm.tables import stored

#: Sets a task remembers while it leaves out copies, and shingles of sets kept between comparisons.
MET, KNOWN = 200_000, 4_000_000
#: Pairs that go to a worker at once.
ROWS = 128


def word_sets(texts: pa.Array, shingle: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text), in pieces of about a megabyte.

    A text of fewer words is one shingle, one without words is the empty set.
    """
    lower, hasher = lower_table(), WordHasher()
    for lo, _, data, offsets in chunks(texts):
        data = lower[data]
        starts, ends, first = word_spans(data, offsets, space_separated())
        hashes = hasher(data, starts, ends)
        own = [hashes[first[row] : first[row + 1]] for row in range(len(offsets) - 1)]
        yield lo, [np.unique(ngram_hashes(w, min(shingle, len(w)))) if len(w) else w for w in own]


def set_name(own: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def set_names(docs: DataFrame, shingle: int, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with node and n: a name of the shingle set (null for the empty one) and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in word_sets(batch.column(0), shingle):
                names = [set_name(s) for s in sets]
                sizes = pa.array([len(s) for s in sets], pa.int64())
                kept = [c.slice(lo, len(sets)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.binary()), sizes], [*keep, "node", "n"])

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(text, *keep).mapInArrow(run, f"{kinds}node binary, n long")


def set_texts(docs: DataFrame, shingle: int, text: str = "text") -> DataFrame:
    """(node, text): one text of each set that is not empty, in buckets of the node.

    A task leaves out copies of the sets it has met lately, so that the text of a large group of copies
    travels once per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            for lo, sets in word_sets(batch.column(0), shingle):
                names, rows = [], []
                for i, own in enumerate(sets):
                    name = set_name(own)
                    if name is not None and name not in met:
                        met.add(name)
                        names.append(name)
                        rows.append(lo + i)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), batch.column(0).take(pa.array(rows, pa.int64()))], ["node", "text"])
                if len(met) > MET:
                    met.clear()

    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "node binary, text string")
    return bucketed(rows.repartition(width, "node").dropDuplicates(["node"]), ["node"], width, "set_texts")


def similar(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets share at least ``percent`` of their union; ``texts``: (node, text).

    b may be in very many pairs: its text is joined first, by the split join for hot keys, so
    that the join of a, which brings the other text, meets keys of few pairs each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            others = batch.column(1).to_pylist()
            new = {n: i for i, n in enumerate(others) if n not in known}
            for lo, sets in word_sets(batch.column(3).take(pa.array(list(new.values()), pa.int64())), shingle):
                known.update(zip(list(new)[lo : lo + len(sets)], sets, strict=True))
            good = np.zeros(batch.num_rows, dtype=bool)
            for lo, sets in word_sets(batch.column(2), shingle):
                for i, own in enumerate(sets, lo):
                    other = known[others[i]]
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    good[i] = 100 * common >= percent * (len(own) + len(other) - common)
            yield batch.select(["a", "b"]).filter(pa.array(good))
            if sum(map(len, known.values())) > KNOWN:
                known.clear()

    pairs = lookup_join(pairs, texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), ["b"], "inner")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def stored_similar(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """:func:`similar`, computed at once: texts go to the workers in batches of few rows, as each may be long."""
    spark = pairs.sparkSession
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), ROWS)))
    try:
        return stored(similar(pairs, texts, shingle, percent), "similar")
    finally:
        spark.conf.set(setting, before)


def side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{name}_{c}") for c in rows.columns])


def ordered_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) once each: the nodes of the left and the right side."""
    return rows.select(F.col("l_node").alias("a"), F.col("r_node").alias("b")).distinct()


def alike_in_size(percent: int) -> Column:
    """Whether two sets l and r can be similar at all, by their sizes."""
    return 100 * F.least("l_n", "r_n") >= percent * F.greatest("l_n", "r_n")

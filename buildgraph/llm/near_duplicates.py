"""Near duplicates: SimHash and rare shingles find candidates, Jaccard similarity of word shingles decides.

Texts with close SimHash fingerprints (Golay keys, :mod:`simhash`) are compared first, by their full sets.
Pairs that differ in more bits, as with one changed passage, are found by rare shingles.

Shingles are five words, lower case, of the whole text.  All shingles have one order, rare ones
first.  Two sets that share t percent of their union share one of the first
n - ceil(t n / 100) + 1 shingles of each (the prefix), so no pair is missed; where the first shared
one stands and the sizes bound what two sets can share.  The order comes from a
sample of the texts: shingles that are frequent in it come last, and before them those of rare words come first,
as their words would rarely meet by chance.  It decides how many texts share a key, not which pairs are found.

Most prefix shingles occur in one set only.  They are counted first, and a Bloom filter of
those that occur twice (16 MB, whatever the input) goes to the tasks; keys that miss it are never
written.  When a very large corpus fills the filter, more keys pass and are counted again later on.

Texts of equal sets are one node.  In each key all nodes are first compared with hubs; nodes that are
linked by then need no comparison, and all pairs of nodes of different groups follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildgraph.llm import simhash
from buildgraph.llm.arrow_words import WordHasher, chunks, lower_table, ngram_hashes, space_separated, word_spans
from buildgraph.llm.components import connected, stars
from buildgraph.llm.set_pairs import ordered_pairs, set_names, set_texts, side, stored_similar, word_sets
from buildgraph.llm.tables import stored

SHINGLE = 5
#: Percent of the union that two sets must share.
SIMILAR = 80
#: One of so many texts is counted for the order of the shingles; so many of the most frequent shingles and words count.
SAMPLED = 8
OFTEN = 200_000
#: Bits of the filter of repeated keys.
FILTER_BITS = 27
#: Comparisons per row of a key up to which no more hubs are tried.
WORK = 64


@dataclass
class Order:
    """The common order of shingles: frequent ones by count, the others by the frequency of their words."""

    often: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    weights: np.ndarray

    def sets(self, texts: pa.Array, shingle: int) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
        """(first row, [(sorted distinct shingles, their places in the order)]) of texts, in pieces."""
        lower, hasher = lower_table(), WordHasher()
        for lo, _, data, offsets in chunks(texts):
            data = lower[data]
            starts, ends, first = word_spans(data, offsets, space_separated())
            hashes = hasher(data, starts, ends)
            # Single words are counted as shingles of one.
            weight = looked_up(ngram_hashes(hashes, 1), self.words, self.weights)
            out = []
            for row in range(len(offsets) - 1):
                own, w = (x[first[row] : first[row + 1]] for x in (hashes, weight))
                n = min(shingle, len(own))
                if not n:
                    out.append((own, w))
                    continue
                found, at = np.unique(ngram_hashes(own, n), return_index=True)
                score = sum(w[i : len(w) - n + 1 + i] for i in range(n))[at]
                out.append((found, (looked_up(found, self.often, self.counts) << 32) + score))
            yield lo, out


def looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each key, zero for those that are not known; ``known`` is sorted."""
    if not len(known):
        return np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], 0)


def common_order(texts: DataFrame, shingle: int) -> Order:
    """The order, from the most frequent shingles and words of a sample of ``texts`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, size in ((0, shingle), (1, 1)):
                for _, sets in word_sets(batch.column(0), size):
                    found, n = np.unique(np.concatenate(sets), return_counts=True)
                    kinds = pa.array(np.full(len(found), kind, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([kinds, pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "h", "n"])

    sample = texts.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0).select("text")
    counts = stored(sample.mapInArrow(run, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")).where("n > 2"), "near-counts")

    def most(kind: int) -> tuple[np.ndarray, np.ndarray]:
        rows = counts.where(F.col("kind") == kind).orderBy(F.desc("n"), "h").limit(OFTEN).select("h", "n").toArrow()
        hashes, n = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
        order = np.argsort(hashes)
        return hashes[order], n[order]

    words, n = most(1)
    return Order(*most(0), words, np.round(64 * np.log2(np.maximum(n, 1))).astype(np.int64))


def prefix(own: np.ndarray, places: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a sorted set in the common order; ties go by hash."""
    size = len(own) - -(-percent * len(own) // 100) + 1
    return own[np.argsort(places, kind="stable")[:size]]


def bits_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key in the filter."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def repeated_filter(texts: DataFrame, order, shingle: int, percent: int) -> np.ndarray:
    """A Bloom filter of the prefix shingles that occur twice; at most 2 ** FILTER_BITS bits reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in order.value.sets(batch.column(0), shingle):
                found, n = np.unique(np.concatenate([prefix(*s, percent) for s in sets]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["h", "n"])

    repeated = texts.select("text").mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    mask = (1 << FILTER_BITS) - 1
    bits = repeated.select(F.explode(F.array(F.expr(f"h & {mask}L"), F.expr(f"shiftright(h, 32) & {mask}L"))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))
    table = words.toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


def prefix_keys(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(h, node, size, place): the prefix of each of ``texts`` (node, text), with the size of its set.

    Left out are shingles that the filter of repeated ones does not hold.
    """
    context = texts.sparkSession.sparkContext
    order = context.broadcast(common_order(texts, shingle))
    known = context.broadcast(repeated_filter(texts, order, shingle, percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, six, one = known.value, np.uint64(6), np.uint64(1)
        for batch in batches:
            for lo, sets in order.value.sets(batch.column(1), shingle):
                firsts = [prefix(*s, percent) for s in sets]
                n = np.array([len(f) for f in firsts])
                rows = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                keys = np.concatenate(firsts)
                a, b = bits_of(keys)
                hit = np.flatnonzero((bits[a >> six] >> (a & np.uint64(63))) & (bits[b >> six] >> (b & np.uint64(63))) & one)
                rows = rows[hit]
                sizes = np.array([len(s) for s, _ in sets], dtype=np.int32)[rows]
                arrays = [pa.array(keys[hit].view(np.int64)), batch.column(0).take(pa.array(rows + lo))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(sizes), pa.array(place[hit].astype(np.int32))], ["h", "node", "size", "place"])

    return texts.select("node", "text").mapInArrow(run, "h long, node binary, size int, place int")


def possible(percent: int) -> Column:
    """Whether l and r can be similar if no shingle before this one is in both."""
    rest = F.least(F.col("l_size") - F.col("l_place"), F.col("r_size") - F.col("r_place"))
    return rest * (100 + percent) >= (F.col("l_size") + F.col("r_size")) * percent


def similar_links(
    texts: DataFrame, shingle: int, percent: int, found: DataFrame | None = None, among: DataFrame | None = None
) -> DataFrame:
    """(a, b): links whose components are those of all similar pairs of ``texts`` (node, text).

    ``found``: (a, b) links that are known already; the result joins what they join.  ``among``: (node), the
    nodes to compare; all without it.
    """
    chosen = texts if among is None else texts.join(among.hint("merge"), "node", "left_semi")
    keys = stored(prefix_keys(chosen, shingle, percent), "near-keys")
    # One row per key, stored before the join, so that a key of very many rows can be split.
    often = stored(keys.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h"), "near-often")
    shared = stored(keys.join(often.hint("merge"), "h"), "near-shared")
    last, turn = None, 0
    while True:
        members = shared.withColumn("root", F.col("node"))
        if found is not None:
            roots = stored(connected(found), "near-roots")
            # What is linked already goes on as one link per node.
            found = stars(roots)
            members = shared.join(roots.select(F.col("node").alias("id"), "root").hint("merge"), F.col("node") == F.col("id"), "left")
            members = members.select("h", "node", "size", "place", F.coalesce("root", "node").alias("root"))
            members = stored(members, "near-members")
        # The largest group of a key and how much is outside it.
        parts = members.groupBy("h", "root").agg(F.count(F.lit(1)).alias("m"))
        tops = parts.groupBy("h").agg(F.max(F.struct("m", "root")).alias("t"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("c"))
        tops = tops.where("c > 1").select("h", F.col("t.root").alias("top"), "m", (F.col("m") - F.col("t.m")).alias("outside"))
        tops = stored(tops, "near-tops")
        row = tops.agg(F.sum(F.col("m") * F.col("outside").cast("double")), F.sum("m")).first()
        if not row[0]:
            break
        left = members.join(tops.select("h", "top").hint("merge"), "h")
        if last is not None and (row[0] <= WORK * row[1] or row[0] > last / 2):
            # The nodes outside the largest group of a key meet all nodes of other groups.
            outer = side(left.where("root != top"), "l")
            once = (F.col("r_root") == F.col("r_top")) | (F.col("l_node") < F.col("r_node"))
            both = outer.join(side(left, "r").hint("merge"), (F.col("l_h") == F.col("r_h")) & (F.col("l_root") != F.col("r_root")) & once & possible(percent))
            found = found.unionByName(stored_similar(stored(ordered_pairs(both), "near-pairs"), texts, shingle, percent))
            break
        last = row[0]
        whole = F.struct(F.xxhash64(F.lit(turn), "node"), "node", "size", "place", "root")
        inner = F.col("root") == F.col("top")
        hubs = left.groupBy("h").agg(F.min(F.when(inner, whole)).alias("x"), F.min(F.when(~inner, whole)).alias("y"))
        hubs = hubs.select("h", F.explode(F.array("x", "y")).alias("x")).select("h", "x.node", "x.size", "x.place", "x.root")
        hubs = stored(hubs, "near-hubs")
        both = side(left.drop("top"), "l").join(side(hubs, "r").hint("merge"), (F.col("l_h") == F.col("r_h")) & (F.col("l_root") != F.col("r_root")) & possible(percent))
        now = stored_similar(stored(ordered_pairs(both), "near-pairs"), texts, shingle, percent)
        found = now if found is None else found.unionByName(now)
        turn += 1
    return found if found is not None else shared.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)


def simhash_links(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): similar pairs of ``texts`` (node, text) with close SimHash fingerprints.

    Fingerprints are grouped as by :mod:`simhash`, by Golay keys; each node of a group is compared with its
    first node by their full sets.  Pairs whose fingerprints are not close are left to :func:`similar_links`.
    """
    prints = simhash.fingerprints(texts, doc_id="node").withColumnRenamed("doc_id", "node")
    prints = stored(prints, "near-prints")
    roots = connected(simhash.links(prints.select("fp").distinct())).withColumnRenamed("node", "fp")
    grouped = prints.join(roots.hint("merge"), "fp", "left").select("node", F.coalesce("root", "fp").alias("group"))
    grouped = stored(grouped, "near-close")
    firsts = grouped.groupBy("group").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Stored, one row per group, so that a group of very many nodes can be split in the join.
    firsts = stored(firsts.select("group", "b"), "near-firsts")
    pairs = grouped.withColumnRenamed("node", "a").join(firsts.hint("merge"), "group").where("a != b").select("a", "b")
    return stored_similar(stored(pairs, "near-pairs"), texts, shingle, percent)


def near_duplicate_leaders(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILAR / 100) -> DataFrame:
    """(k, group, leader) for each distinct k of ``docs`` (k, doc_id, text).

    leader marks the k with the smallest (doc_id, k) of its group; a null doc_id counts as
    the smallest.  Texts without words, also null, are one group.
    """
    percent = round(similarity * 100)
    names = set_names(docs, shingle, ["k", "doc_id"]).withColumn("node", F.coalesce("node", F.lit(b"")))
    names = stored(names, "near-names")
    nodes = stored(names.groupBy("node").agg(F.min(F.struct("doc_id", "k")).alias("first")), "near-nodes")
    texts = set_texts(docs, shingle)
    roots = connected(similar_links(texts, shingle, percent, simhash_links(texts, shingle, percent)))
    leaders = nodes.join(roots.hint("merge"), "node", "left").select("node", "first", F.coalesce("root", "node").alias("group"))
    leaders = stored(leaders, "near-groups")
    best = stored(leaders.groupBy("group").agg(F.min("first").alias("best")), "near-best")
    leaders = stored(leaders.join(best.hint("merge"), "group").select("node", "group", F.col("best.k").alias("best")), "near-leaders")
    rows = names.join(leaders.hint("merge"), "node").select("k", "group", (F.col("k") == F.col("best")).alias("leader"))
    return rows.distinct()

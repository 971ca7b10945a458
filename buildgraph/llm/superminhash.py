"""MinHash near duplicates with SuperMinHash signatures.

The set of a document is its distinct word shingles.  Every shingle ranks the slots of a signature
by its own random permutation; a slot keeps the least value rank + fraction any shingle
gives it.  A shingle's ranks are all different, so slots are not hit by chance twice while others stay
empty, which makes the share of equal slots a less scattered estimate than with independent hashes.
Ranks are handed out one after the other for all shingles of a batch; a document is
done as soon as each of its slots holds a value below the next rank.

Signatures are cut into bands.  With 32 bands of 5 slots a pair of similarity 0.8 shares none
with a probability below 4 in a million, a pair of 0.9 below 1 in 10^12.  The distinct sets of a band
are first compared with two hubs of it, by their full sets; what is linked by then
needs no other comparison.  In bands that few sets share, all pairs of different groups follow.  A band that
many share is a crowd of sets that are half alike (one passage in thousands of texts); pairing it
would cost the square of its size.  Before texts are joined for a comparison, four bits of each slot of
both signatures must agree as often as those of similar sets do (six standard deviations below).
The sets of large bands are compared exactly by another way, the rare shingles
that two similar sets must have in common (:mod:`near_duplicates`), so no band is cut and no pair of it lost.
Union-find over stored edges names the groups.

Documents of equal sets are one node; they are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.skew import lookup_join
from buildgraph.llm.arrow_words import mixed
from buildgraph.llm.components import connected, stars
from buildgraph.llm.near_duplicates import similar_links
from buildgraph.llm.set_pairs import alike_in_size, ordered_pairs, set_names, set_texts, side, stored_similar, word_sets
from buildgraph.llm.tables import stored

SHINGLE = 4
#: Percent of the union that two sets must share.
SIMILAR = 80
BANDS, ROWS = 32, 5
#: Rounds of hubs, and sets of a band up to which all its pairs are compared.
HUB_TURNS, PAIRED = 2, 16
#: Odd constants that tell the random streams of a shingle apart.
STREAM, FRACTION = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash of every set: one row of values each; equal values are equal slots.

    A value is rank and fraction as one integer.  Empty sets have no signature (the largest
    value everywhere).
    """
    n = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full(len(sets) * slots, np.iinfo(np.uint64).max, dtype=np.uint64)
    if not n.sum():
        return out.reshape(-1, slots)
    items, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = None
    for rank in range(slots):
        moved, flipped = [np.uint64((rank + 1) * c % (1 << 64)) for c in (STREAM, FRACTION)]
        pick = rank + (mixed(items + moved) % np.uint64(slots - rank)).astype(np.int64)
        if rank == 0:
            slot = pick
        else:
            # The permutations as far as they are drawn: swap the picked slot into this place.
            every = np.arange(len(items))
            slot = order[every, pick]
            order[every, pick] = order[:, rank]
            order[:, rank] = slot
        fraction = mixed(items ^ flipped) >> np.uint64(8)
        np.minimum.at(out, doc * slots + slot, fraction + (np.uint64(rank) << np.uint64(56)))
        # A slot below the next rank cannot change any more.
        open_docs = (out.reshape(-1, slots) >= (np.uint64(rank + 1) << np.uint64(56))).any(axis=1) & (n > 0)
        keep = open_docs[doc]
        if not keep.any():
            break
        if rank == 0:
            items, doc, pick = items[keep], doc[keep], pick[keep]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(items), 1))
            every = np.arange(len(items))
            order[every, pick] = 0
            order[:, 0] = pick
        elif not keep.all():
            items, doc, order = items[keep], doc[keep], order[keep]
    return out.reshape(-1, slots)


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per signature and band."""
    parts = values.reshape(len(values), bands, -1)
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(values), 1))
    for i in range(parts.shape[2]):
        out = mixed(out * np.uint64(STREAM) + parts[:, :, i])
    return out


def sketches(values: np.ndarray) -> pa.Array:
    """Four bits of every slot, sixteen slots to a long (the last one padded)."""
    slots = values.shape[1]
    padded = np.zeros((len(values), -(-slots // 16) * 16), dtype=np.uint64)
    # The low bits of a value are those of the fraction, which are random.
    padded[:, :slots] = values & np.uint64(15)
    shifts = (np.arange(16) * 4).astype(np.uint64)
    longs = np.bitwise_or.reduce(padded.reshape(len(values), -1, 16) << shifts, axis=2)
    return pa.FixedSizeListArray.from_arrays(pa.array(longs.ravel().view(np.int64)), longs.shape[1]).cast(pa.list_(pa.int64()))


def least_agreement(slots: int, percent: int) -> int:
    """Slots that two sets of the wanted similarity have in common but for a chance below one in 10^8.

    Six standard deviations of independent slots below the mean; those of SuperMinHash scatter less.
    """
    share = percent / 100
    return max(int(slots * share - 6 * (slots * share * (1 - share)) ** 0.5), 0)


def promising(pairs: DataFrame, known: DataFrame, slots: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches agree often enough; ``known``: (node, sketch).

    Slots that differ look equal with a chance of one in sixteen, so agreement is never underestimated.
    """
    pairs = lookup_join(pairs, known.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), ["b"], "inner")
    both = pairs.join(known.select(F.col("node").alias("a"), F.col("sketch").alias("sa")).hint("merge"), "a")
    # One bit of each group of four that differ.
    lowest = 0x1111111111111111
    unequal = F.zip_with("sa", "sb", lambda x, y: x.bitwiseXOR(y))
    bits = F.transform(
        unequal,
        lambda x: F.bit_count(
            x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3)).bitwiseAND(F.lit(lowest))
        ),
    )
    differ = F.aggregate(bits, F.lit(0), lambda a, b: a + b)
    return both.where(F.lit(slots) - differ >= least_agreement(slots, percent)).select("a", "b")


def keys_of(texts: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(h, node, n, sketch): the band keys of ``texts`` (node, text) with the sizes of the sets.

    The sketch of a node comes with its first key only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in word_sets(batch.column(1), shingle):
                values = signatures(sets, bands * rows)
                keys = band_keys(values, bands)
                first = pa.array(np.where(np.arange(len(sets) * bands) % bands == 0, np.arange(len(sets) * bands) // bands, -1))
                short = sketches(values).take(pc.if_else(pc.less(first, 0), None, first))
                at = pa.array(np.repeat(np.arange(lo, lo + len(sets)), bands))
                sizes = np.repeat(np.array([len(s) for s in sets], dtype=np.int64), bands)
                arrays = [pa.array(keys.ravel().view(np.int64)), batch.column(0).take(at), pa.array(sizes), short]
                yield pa.RecordBatch.from_arrays(arrays, ["h", "node", "n", "sketch"])

    return texts.select("node", "text").mapInArrow(run, "h long, node binary, n long, sketch array<long>")


def links(texts: DataFrame, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(a, b): links whose groups are those of all similar pairs of ``texts`` (node, text) that share a band."""
    keys = stored(keys_of(texts, shingle, bands, rows), "mh-keys")
    known = keys.where("sketch IS NOT NULL").select("node", "sketch")
    slots = bands * rows
    # Stored, one row per key, so that a key of very many rows can be split in the join.
    often = stored(keys.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h"), "mh-often")
    shared = stored(keys.select("h", "node", "n").join(often.hint("merge"), "h"), "mh-shared")
    found = None
    members = shared.withColumn("root", F.col("node"))
    for turn in range(HUB_TURNS + 1):
        if found is not None:
            roots = stored(connected(found), "mh-roots")
            # What is linked already goes on as one link per node.
            found = stars(roots)
            members = shared.join(roots.withColumnRenamed("node", "id").hint("merge"), F.col("node") == F.col("id"), "left")
            members = stored(members.select("h", "node", "n", F.coalesce("root", "node").alias("root")), "mh-members")
        # The largest group of a band, and what is outside it.
        parts = members.groupBy("h", "root").agg(F.count(F.lit(1)).alias("m"))
        tops = parts.groupBy("h").agg(F.max(F.struct("m", "root")).alias("t"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("c"))
        tops = stored(tops.where("c > 1").select("h", F.col("t.root").alias("top"), "m"), "mh-tops")
        left = members.join(tops.hint("merge"), "h")
        if turn == HUB_TURNS:
            break
        whole = F.struct(F.xxhash64(F.lit(turn), "node"), "node", "n", "root")
        inner = F.col("root") == F.col("top")
        hubs = left.groupBy("h").agg(F.min(F.when(inner, whole)).alias("x"), F.min(F.when(~inner, whole)).alias("y"))
        hubs = stored(hubs.select("h", F.explode(F.array("x", "y")).alias("x")).select("h", "x.node", "x.n", "x.root"), "mh-hubs")
        both = side(left.drop("top", "m"), "l").join(side(hubs, "r").hint("merge"), F.col("l_h") == F.col("r_h"))
        pairs = stored(ordered_pairs(both.where((F.col("l_root") != F.col("r_root")) & alike_in_size(percent))), "mh-pairs")
        now = stored_similar(stored(promising(pairs, known, slots, percent), "mh-promising"), texts, shingle, percent)
        found = now if found is None else found.unionByName(now)
    few, many = left.where(F.col("m") <= PAIRED), left.where(F.col("m") > PAIRED)
    once = (F.col("l_root") != F.col("r_root")) & (F.col("l_node") < F.col("r_node")) & alike_in_size(percent)
    both = side(few, "l").join(side(few, "r").hint("merge"), (F.col("l_h") == F.col("r_h")) & once)
    pairs = stored(promising(stored(ordered_pairs(both), "mh-pairs"), known, slots, percent), "mh-promising")
    found = found.unionByName(stored_similar(pairs, texts, shingle, percent))
    crowd = stored(many.select("node").distinct(), "mh-crowd")
    return similar_links(texts, shingle, percent, found, among=crowd)


def near_duplicate_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    percent: int = SIMILAR,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    A-Z are lower-cased, words are separated by white space.  component_id is the smallest doc_id reachable
    over links, itself included; a null doc_id never becomes one unless its group has no other.
    Rows without words, also null, have the empty set and link with nothing: each is its own
    component.  Repeated rows are equal sets and get equal rows.  Texts are read whole, whatever their length.
    Other columns, whatever their names, are not read; an empty table gives an empty one.
    """
    if bands * rows > 255:
        raise ValueError("a signature has at most 255 slots")
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    names = stored(set_names(docs, shingle, ["doc_id"]), "mh-names")
    nodes = stored(names.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first")), "mh-nodes")
    edges = links(set_texts(docs, shingle), shingle, percent, bands, rows)
    roots = connected(edges)
    named = nodes.join(roots.hint("merge"), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = stored(named, "mh-named")
    best = stored(named.groupBy("root").agg(F.min("first").alias("component_id")), "mh-best")
    labels = stored(named.join(best.hint("merge"), "root").select("node", "component_id"), "mh-labels")
    out = names.join(labels.hint("merge"), "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op12(docs: DataFrame) -> DataFrame:
    """The contract's columns; a row of null doc_id is kept if its whole group has none."""
    out = near_duplicate_groups(docs)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

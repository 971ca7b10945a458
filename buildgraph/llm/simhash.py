"""SimHash near-duplicates with Golay-code fuzzy keys.

A fingerprint has 64 bits.  It is cut into three segments of 22, 21 and 21 bits.
A segment, padded to 23 bits, lies within three bits of exactly one codeword of
the binary Golay code; decoding it and its 23 neighbours gives one or six
12-bit codeword indices, and a segment one bit away decodes to one of them.
Two fingerprints that differ in at most two bits agree, by the pigeonhole
principle, in one of four ways, each of which is one kind of key:

* A equal and B at most one bit apart, * B equal and A at most one bit apart,
* C equal and A at most one bit apart, * B and C equal.

Fingerprints that share a key are joined and verified by the bits that differ.
Keys that many fingerprints share (large groups of near copies) are not
paired: each of their fingerprints goes to its 65 neighbourhood points
(itself and each one-bit change) instead.  Two fingerprints meet in a point exactly
if they differ in at most two bits, so the links are the same and the work
stays in proportion to the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.storage import materialize
from buildgraph.llm.arrow_words import chunks, lower_table, space_separated, word_spans
from buildgraph.llm.components import connected

#: Generator polynomial of the binary Golay code of length 23 (a fixed value).
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key up to which they are paired; larger groups meet in neighbourhood points.
PAIRED = 16


def single_spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with each run of white space after a word as one space, other white space dropped."""
    inside = space_separated()[data]
    follows = np.zeros(len(data), dtype=bool)
    follows[1:] = inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    follows[edges] = False
    keep = inside | follows
    total = np.concatenate([[0], np.cumsum(keep)])
    out = np.where(inside, data, np.uint8(0x20))[keep]
    return out, total[offsets]


def simhash_column(texts: pa.Array, shingle: int) -> np.ndarray:
    """The 64-bit fingerprint of every text of a column."""
    prints = np.zeros(len(texts), dtype=np.uint64)
    lower = lower_table()
    for lo, _, data, offsets in chunks(texts):
        data, offsets = single_spaced(lower[data], offsets)
        starts, ends, first = word_spans(data, offsets, space_separated())
        raw = data.tobytes()
        for row in range(len(offsets) - 1):
            a, b = first[row], first[row + 1]
            if a == b:
                continue
            n = max(b - a - shingle + 1, 1)
            last = min(shingle, b - a) - 1
            spans = zip(starts[a : a + n].tolist(), ends[a + last : a + last + n].tolist(), strict=True)
            hashes = np.fromiter((xxhash.xxh64_intdigest(raw[s:e], 42) for s, e in spans), np.uint64, n)
            prints[lo + row] = majority(hashes)
    return prints


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    over = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp): SimHash of word shingles, one row per input row.

    A-Z are lower-cased, words are separated by white space, repeats count.
    Texts of fewer words than a shingle are one shingle; without words, also
    null, the fingerprint is zero.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = simhash_column(batch.column(1), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "fp"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    rest = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ np.uint32(GENERATOR << (bit - 11)), rest)
    return rest


def error_patterns() -> np.ndarray:
    """The only pattern of at most three wrong bits for each of the 2048 syndromes."""
    bits = [1 << i for i in range(23)]
    patterns = [0, *bits]
    patterns += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    patterns += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    found = np.array(patterns, dtype=np.uint32)
    table = np.zeros(2048, dtype=np.uint32)
    table[syndromes(found)] = found
    return table


def codeword_indices(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Indices of the codewords next to each word (column 0) and to its 23 neighbours."""
    flips = np.array([0] + [1 << i for i in range(23)], dtype=np.uint32)
    near = words.astype(np.uint32)[:, None] ^ flips[None, :]
    wrong = table[syndromes(words)[:, None] ^ syndromes(flips)[None, :]]
    return (near ^ wrong) >> 11


def golay_keys(prints: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, exact) of all keys; exact marks the key of the unchanged segment."""
    seg = [(prints >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
    near = [codeword_indices(s, table).astype(np.uint64) for s in seg[:2]]
    rows, keys, exact = [], [], []
    every = np.arange(len(prints))
    for kind, (same, fuzzy) in enumerate(((0, 1), (1, 0), (2, 0))):
        base = (np.uint64(kind) << np.uint64(60)) | (seg[same] << np.uint64(12))
        codes = np.sort(near[fuzzy], axis=1)
        fresh = np.ones(codes.shape, dtype=bool)
        fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
        r, c = np.nonzero(fresh)
        rows.append(r)
        keys.append(base[r] | codes[r, c])
        exact.append(codes[r, c] == near[fuzzy][r, 0])
    rows.append(every)
    keys.append((np.uint64(3) << np.uint64(60)) | (seg[1] << np.uint64(21)) | seg[2])
    exact.append(np.ones(len(prints), dtype=bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(exact)


def fuzzy_keys(prints: DataFrame) -> DataFrame:
    """(key, fp, exact) of distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = error_patterns()
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                rows, keys, exact = golay_keys(fp.view(np.uint64), table)
                arrays = [pa.array(keys.view(np.int64)), pa.array(fp[rows]), pa.array(exact)]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "fp", "exact"])

    return prints.select("fp").mapInArrow(run, "key long, fp long, exact boolean")


def links(prints: DataFrame) -> DataFrame:
    """(a, b): edges that connect distinct fingerprints at most two bits apart.

    Small key groups give every link; large ones give, through neighbourhood
    points, edges with the same connected components.
    """
    keys = materialize(fuzzy_keys(prints), "simhash-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("exact").alias("probed"))
    sizes = materialize(sizes.where("n > 1 and probed").select("key", "n"), "simhash-sizes")
    shared = materialize(keys.join(sizes, "key"), "simhash-shared")
    few = shared.where(F.col("n") <= PAIRED)
    left = few.where("exact").select("key", F.col("fp").alias("a"))
    right = few.select("key", F.col("fp").alias("b"))
    pairs = (
        left.join(right, "key")
        .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    many = shared.where(F.col("n") > PAIRED).select("fp").distinct()
    flips = F.expr("array_append(transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)), fp)")
    points = materialize(many.select("fp", F.explode(flips).alias("point")), "simhash-points")
    nearest = points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    nearest = materialize(nearest, "simhash-nearest")
    stars = points.join(nearest, "point").where("fp != a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicate_groups(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every input row.

    Rows link if their fingerprints differ in at most two bits; component_id is
    the smallest doc_id reachable, itself included.  Rows with equal
    fingerprints are one node, so copies are never paired.  Rows without words
    share fingerprint zero and link like any other; a null doc_id never becomes a
    component_id unless nothing else is in the component.
    """
    prints = materialize(fingerprints(docs, shingle, text, doc_id), "simhash-prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = materialize(nodes, "simhash-nodes")
    roots = connected(links(nodes))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named, "simhash-named")
    smallest = materialize(named.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-smallest")
    labels = materialize(named.join(smallest, "root").select("fp", "component_id"), "simhash-labels")
    return prints.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def op9(docs: DataFrame) -> DataFrame:
    """The contract's digest columns."""
    out = near_duplicate_groups(docs, shingle=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

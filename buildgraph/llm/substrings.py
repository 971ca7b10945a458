"""Repeated passages, removed by matching statistics against suffix automata.

Every window of 20 words has an anchor: the run of six words in it whose hash is
least.  Equal windows have equal anchors, so only windows whose anchor occurs
twice can repeat.  Neighbouring windows with one anchor are a segment of the
text; equal segments are kept once, with the place where they start first.

The distinct segments of an anchor are the reference text of that anchor.  Anchors are
dealt to reference shards of bounded size.  A task takes a shard's segments in
order of place, streams each through the suffix automaton of those before it and
reads the matching statistics: a window that ends where 20 or more words match has
occurred earlier.  Then the automaton takes the segment in.  A shard gets
just the text that can match it, instead of every shard being sent to every document,
which would cost shards times corpus.

Anchors with very many distinct segments (a passage in many different
surroundings) would fill one shard; their windows are compared one by one by hash
with a distributed aggregate, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.storage import materialize
from buildgraph.llm.arrow_words import WordHasher, chunks, ngram_hashes, space_separated, word_spans
from buildgraph.llm.lines import row_key
from buildgraph.llm.simhash import single_spaced
from buildgraph.llm.tables import stored

WINDOW = 20
ANCHOR = 6
#: Words of a reference shard, about; bounds the automaton a task holds.
SHARD_WORDS = 40_000
#: Distinct segments of an anchor from which its windows are compared by hash.
CROWDED = 1000
#: Bits of the filter of repeated anchors that travels to the tasks (16 MB, whatever the input).
#: If it fills up, more segments than needed are looked at; the result is the same.
FILTER_BITS = 27


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by its first."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        step = width - have
        out = np.minimum(out[: len(out) - step], out[step:])
    return out


def segments(words: np.ndarray, first: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of all segments of the rows' words."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(words) < window:
        return none
    grams = ngram_hashes(words, anchor)
    low = np.uint64((1 << 20) - 1)
    placed = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    least = least_of(placed, window - anchor + 1)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    lengths = first[1:] - first[:-1]
    wide = lengths >= window
    np.add.at(inside, first[:-1][wide], 1)
    np.add.at(inside, first[1:][wide] - window + 1, -1)
    valid = np.cumsum(inside)[: len(least)] > 0
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    starts = np.flatnonzero(opens)
    if not len(starts):
        return none
    ends = np.append(starts[1:], len(least))
    stops = np.flatnonzero(valid & ~np.append(valid[1:], False)) + 1
    ends = np.minimum(ends, stops[np.searchsorted(stops, starts, side="right")])
    return least[starts] >> np.uint64(20), starts, ends - starts


def filter_places(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each anchor in the filter."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return anchors & mask, (anchors >> np.uint64(17)) & mask


def anchor_counts(docs: DataFrame) -> DataFrame:
    """(anchor, n): how many segments each anchor has, counted within each slice first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                starts, ends, first = word_spans(data, offsets, space_separated())
                anchors, _, _ = segments(hasher(data, starts, ends), first)
                found, n = np.unique(anchors, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def repeated_filter(docs: DataFrame) -> np.ndarray:
    """A Bloom filter of the anchors that occur more than once; 2 ** FILTER_BITS bits reach the driver at most."""
    repeated = anchor_counts(docs).where("n > 1")
    mask = (1 << FILTER_BITS) - 1
    bits = repeated.select(F.explode(F.array(F.expr(f"anchor & {mask}L"), F.expr(f"shiftright(anchor, 17) & {mask}L"))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))
    table = words.toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


def repeated_segments(docs: DataFrame) -> DataFrame:
    """(anchor, seg, k, doc_id, start, windows, words) of segments whose anchor may be repeated.

    ``seg`` is a 64-bit hash of the words, which counts within its anchor only; the words themselves come with the first such segment
    of a slice only.
    """
    known = docs.sparkSession.sparkContext.broadcast(repeated_filter(docs))
    kind = dict(docs.dtypes)["doc_id"]
    names = ["anchor", "seg", "k", "doc_id", "start", "windows", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = WordHasher(), known.value
        for batch in batches:
            for lo, _, data, offsets in chunks(batch.column(2)):
                data, offsets = single_spaced(data, offsets)
                starts, ends, first = word_spans(data, offsets, space_separated())
                anchors, begin, windows = segments(hasher(data, starts, ends), first)
                a, b = filter_places(anchors)
                six, one = np.uint64(6), np.uint64(1)
                hit = (bits[a >> six] >> (a & np.uint64(63))) & (bits[b >> six] >> (b & np.uint64(63))) & one
                take = np.flatnonzero(hit)
                begin, windows = begin[take], windows[take]
                raw = data.tobytes()
                seen: set[int] = set()
                segs, texts = [], []
                spans = zip(starts[begin].tolist(), ends[begin + windows + WINDOW - 2].tolist(), strict=True) if len(take) else ()
                for s, e in spans:
                    text = raw[s:e]
                    seg = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                    segs.append(seg)
                    texts.append(None if seg in seen else text)
                    seen.add(seg)
                row = np.searchsorted(first, begin, side="right") - 1
                at = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchors[take].view(np.int64)),
                        pa.array(segs, pa.int64()),
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(begin - first[row]),
                        pa.array(windows),
                        pa.array(texts, pa.binary()),
                    ],
                    names,
                )

    schema = f"anchor long, seg long, k long, doc_id {kind}, start long, windows long, words binary"
    return stored(docs.select("k", "doc_id", "text").mapInArrow(run, schema), "segments")


class SuffixAutomaton:
    """A suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self._next: list[dict[bytes, int]] = [{}]
        self._link = [-1]
        self._length = [0]

    def matches(self, words: list[bytes]) -> list[int]:
        """Matching statistics: the longest match that ends at each word."""
        out, state, length = [], 0, 0
        for w in words:
            while state and w not in self._next[state]:
                state = self._link[state]
                length = self._length[state]
            to = self._next[state].get(w)
            if to is not None:
                state, length = to, length + 1
            else:
                length = 0
            out.append(length)
        return out

    def _split(self, state: int, word: bytes, to: int) -> int:
        """The state that ``word`` leads to from ``state``, made one longer than it if needed."""
        if self._length[state] + 1 == self._length[to]:
            return to
        copy = len(self._next)
        self._next.append(self._next[to].copy())
        self._length.append(self._length[state] + 1)
        self._link.append(self._link[to])
        self._link[to] = copy
        while state >= 0 and self._next[state].get(word) == to:
            self._next[state][word] = copy
            state = self._link[state]
        return copy

    def add(self, words: list[bytes]) -> None:
        """Take another sequence in."""
        last = 0
        for w in words:
            to = self._next[last].get(w)
            if to is not None:
                last = self._split(last, w, to)
                continue
            fresh = len(self._next)
            self._next.append({})
            self._length.append(self._length[last] + 1)
            self._link.append(0)
            state = last
            while state >= 0 and w not in self._next[state]:
                self._next[state][w] = fresh
                state = self._link[state]
            if state >= 0:
                self._link[fresh] = self._split(state, w, self._next[state][w])
            last = fresh


def seen_windows(contested: DataFrame) -> DataFrame:
    """(anchor, seg, seen): for distinct segments, the windows that an earlier segment of the shard holds."""
    rows = contested.select("shard", "first.doc_id", "first.k", "first.start", "anchor", "seg", "words")
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "doc_id", "k", "start").select("shard", "anchor", "seg", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton = None, SuffixAutomaton()
        for batch in batches:
            anchors, segs, seen = [], [], []
            for own, anchor, seg, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != shard:
                    shard, automaton = own, SuffixAutomaton()
                words = text.split(b" ")
                found = automaton.matches(words)
                places = [i for i, n in enumerate(found[WINDOW - 1 :]) if n >= WINDOW]
                if places:
                    anchors.append(anchor)
                    segs.append(seg)
                    seen.append(places)
                if len(places) < len(words) - WINDOW + 1:
                    automaton.add(words)
            arrays = [pa.array(anchors, pa.int64()), pa.array(segs, pa.int64()), pa.array(seen, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["anchor", "seg", "seen"])

    return dealt.mapInArrow(run, "anchor long, seg long, seen array<long>")


def crowded_windows(crowded: DataFrame) -> DataFrame:
    """(anchor, seg, seen) as :func:`seen_windows`, one window at a time."""
    words = crowded.withColumn("w", F.split(F.col("words").cast("string"), " "))
    each = words.select("anchor", "seg", "first", "w", F.explode(F.sequence(F.lit(0), F.size("w") - WINDOW)).alias("at"))
    text = F.array_join(F.slice("w", F.col("at") + 1, WINDOW), " ")
    place = F.struct("first.doc_id", "first.k", (F.col("first.start") + F.col("at")).alias("start"))
    hashed = each.select("anchor", "seg", F.col("at").cast("long").alias("at"), place.alias("place"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))
    hashed = stored(hashed, "crowded")
    least = stored(hashed.groupBy("a", "b").agg(F.min("place").alias("least")), "crowded-least")
    later = hashed.join(least, ["a", "b"]).where((F.col("place.k") != F.col("least.k")) | (F.col("place.start") != F.col("least.start")))
    return later.groupBy("anchor", "seg").agg(F.collect_list("at").alias("seen"))


def removed_windows(docs: DataFrame) -> DataFrame:
    """(k, gone: windows (start, windows, seen)) of ``docs`` (k, doc_id, text).

    ``seen`` null means all windows from start on.
    """
    occurrences = repeated_segments(docs)
    distinct = occurrences.groupBy("anchor", "seg").agg(
        F.min(F.struct("doc_id", "k", "start")).alias("first"), F.max("words").alias("words"), F.max("windows").alias("windows"), F.count(F.lit(1)).alias("n")
    )
    distinct = stored(distinct, "distinct-segments")
    rivals = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("rivals"), F.sum("windows").alias("size")).where("rivals > 1")
    rivals = materialize(rivals, "anchors")
    size = rivals.where(F.col("rivals") <= CROWDED).agg(F.sum(F.col("size") + F.col("rivals") * (WINDOW - 1))).first()[0] or 0
    shards = max(1, -(-size // SHARD_WORDS))
    contested = distinct.join(rivals.select("anchor", "rivals"), "anchor")
    ordinary = contested.where(F.col("rivals") <= CROWDED).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    crowded = contested.where(F.col("rivals") > CROWDED)
    seen = materialize(seen_windows(ordinary).unionByName(crowded_windows(crowded)), "seen")
    verdicts = distinct.select("anchor", "seg", "first", "n").join(seen, ["anchor", "seg"], "left").where("n > 1 or seen is not null")
    # Stored, so that a segment with very many occurrences can be split in the join below.
    verdicts = materialize(verdicts.select("anchor", "seg", F.col("first.k").alias("first_k"), F.col("first.start").alias("first_start"), "seen"), "verdicts")
    joined = occurrences.select("anchor", "seg", "k", "start", "windows").join(verdicts, ["anchor", "seg"])
    origin = (F.col("first_k") == F.col("k")) & (F.col("first_start") == F.col("start"))
    gone = joined.where(~origin | F.col("seen").isNotNull()).select("k", F.struct("start", "windows", F.when(origin, F.col("seen")).alias("seen")).alias("g"))
    return gone.groupBy("k").agg(F.collect_set("g").alias("gone"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words of each row that no earlier passage holds.

    Words are separated by white space.  A window is judged on the input; (doc_id, content, start)
    is the order, a null doc_id counts as the smallest.  Rows equal in id and text are one
    document and get the same result.  Null and empty texts have no words.
    """
    keyed = docs.select(row_key(F.col(doc_id), F.col(text)).alias("k"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    gone = materialize(removed_windows(keyed), "gone")
    rows = keyed.join(gone, "k", "left").select("doc_id", "text", "gone")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_removed", "kept"]
        for batch in batches:
            cuts = batch.column(2)
            for lo, hi, data, offsets in chunks(batch.column(1)):
                data, offsets = single_spaced(data, offsets)
                starts, ends, first = word_spans(data, offsets, space_separated())
                raw = data.tobytes()
                removed, kept = [], []
                for row in range(hi - lo):
                    a, b = first[row], first[row + 1]
                    marks = cuts[lo + row].as_py()
                    if not marks:
                        removed.append(0)
                        kept.append(raw[starts[a] : ends[b - 1]] if b > a else b"")
                        continue
                    change = np.zeros(b - a + 1, dtype=np.int64)
                    for mark in marks:
                        at, n = mark["start"], mark["windows"]
                        for w in [range(n)] if mark["seen"] is None else [range(i, i + 1) for i in mark["seen"]]:
                            change[at + w.start] += 1
                            change[at + w.stop + WINDOW - 1] -= 1
                    stay = np.flatnonzero(np.cumsum(change[:-1]) == 0) + a
                    removed.append(int(b - a - len(stay)))
                    kept.append(b" ".join(raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)))
                arrays = [batch.column(0).slice(lo, hi - lo), pa.array(first[1:] - first[:-1]), pa.array(removed, pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.binary()).cast(pa.string())], names)

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op5(docs: DataFrame) -> DataFrame:
    """The contract's digest columns."""
    out = without_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

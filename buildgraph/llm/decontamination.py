"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of about a megabyte of documents inside a task.  Its words
become symbols of the test vocabulary; every other word is a separator, and
stretches shorter than the shortest window cannot hold one and are left out.
All windows of the test items are searched backward at once, occurrences are
located through sampled suffix positions, and overlapping ones merge into spans
of document words.  Nothing is shuffled and the result of a document does not depend on
the shard it is in.

The test windows travel to the tasks.  They are taken in blocks of at most
``BLOCK_WORDS`` item words, so what is sent is bounded; a larger benchmark takes one
pass over the documents per block, and the blocks' spans are merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildgraph.llm.arrow_words import WordHasher, chunks, letters_and_digits, lower_table, word_spans
from buildgraph.llm.fm_index import FMIndex

WINDOW = 10
BLOCK_WORDS = 2_000_000


@dataclass
class Windows:
    """The distinct windows of a block of items over a numbered vocabulary."""

    words: list[bytes] = field(default_factory=list)
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    symbols: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    patterns: np.ndarray = field(default_factory=lambda: np.zeros((0, WINDOW), np.int64))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    items: list[list[int]] = field(default_factory=list)
    item_ids: list[str] = field(default_factory=list)


def item_words(texts: pa.Array) -> list[list[bytes]]:
    """The words of each test item."""
    out: list[list[bytes]] = []
    lower = lower_table()
    for _, _, data, offsets in chunks(texts):
        data = lower[data]
        raw = data.tobytes()
        starts, ends, first = word_spans(data, offsets, letters_and_digits())
        for row in range(len(offsets) - 1):
            spans = range(first[row], first[row + 1])
            out.append([raw[starts[i] : ends[i]] for i in spans])
    return out


def windows_of(items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> Windows:
    """Number the vocabulary and collect each window once, with the items that hold it."""
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[int]] = {}
    for number, (_, words) in enumerate(items):
        coded = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        for at in range(max(len(coded) - window + 1, min(len(coded), 1))):
            found.setdefault(tuple(coded[at : at + window]), set()).add(number)
    out = Windows(words=[b"", *vocabulary], item_ids=[i for i, _ in items])
    if not vocabulary:
        return out
    raw = np.frombuffer(b"".join(vocabulary), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in vocabulary])
    hashes = WordHasher()(raw, np.concatenate([[0], ends[:-1]]), ends)
    order = np.argsort(hashes)
    out.hashes, out.symbols = hashes[order], order.astype(np.int64) + 1
    out.patterns = np.zeros((len(found), window), dtype=np.int64)
    out.lengths = np.array([len(w) for w in found], dtype=np.int64)
    for row, key in enumerate(found):
        out.patterns[row, window - len(key) :] = key
    out.items = [sorted(v) for v in found.values()]
    return out


def word_symbols(raw: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, w: Windows, first: np.ndarray) -> np.ndarray:
    """The vocabulary number of each word, 0 outside the vocabulary or in too short a stretch.

    Numbers are looked up by hash and then compared byte for byte.
    """
    at = np.minimum(np.searchsorted(w.hashes, hashes), len(w.hashes) - 1)
    symbols = np.where(w.hashes[at] == hashes, w.symbols[at], 0)
    edge = np.zeros(len(symbols) + 1, dtype=bool)
    edge[first] = True
    known = symbols > 0
    opens = known & (edge[:-1] | ~np.concatenate([[False], known[:-1]]))
    closes = known & (edge[1:] | ~np.concatenate([known[1:], [False]]))
    heads, tails = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    short = (tails - heads) < int(w.lengths.min())
    drop = np.zeros(len(symbols) + 1, dtype=np.int64)
    np.add.at(drop, heads[short], 1)
    np.add.at(drop, tails[short], -1)
    symbols[np.cumsum(drop[:-1]) > 0] = 0
    for i in np.flatnonzero(symbols):
        if w.words[symbols[i]] != raw[starts[i] : ends[i]]:
            symbols[i] = 0
    return symbols


def shard_text(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, word index of each place): stretches of known words between single separators."""
    keep = symbols > 0
    edge = np.zeros(len(symbols) + 1, dtype=bool)
    edge[first] = True
    opens = np.flatnonzero(keep & (edge[:-1] | ~np.concatenate([[False], keep[:-1]])))
    places = np.flatnonzero(keep)
    at = np.searchsorted(places, opens)
    sequence = np.insert(symbols[places], at, 0)
    words = np.insert(places, at, -1)
    return np.append(sequence, 0), np.append(words, -1)


def shard_hits(raw: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(word index, window number) of every occurrence that starts there."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(starts) or not len(w.lengths):
        return none
    symbols = word_symbols(raw, starts, ends, hashes, w, first)
    if not symbols.any():
        return none
    sequence, words = shard_text(symbols, first)
    index = FMIndex(sequence, len(w.words))
    lo, hi = index.search(w.patterns, w.lengths)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return none
    sizes = hi[found] - lo[found]
    rows = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return words[index.locate(rows)], np.repeat(found, sizes)


def merged_spans(at: np.ndarray, until: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching [start, end) word spans as one."""
    out: list[tuple[int, int]] = []
    order = np.argsort(at, kind="stable")
    for a, b in zip(at[order].tolist(), until[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def removal_spans(docs: DataFrame, windows: Windows, text: str = "text") -> DataFrame:
    """``docs`` with n_words, items (item_ids found) and spans (start word, end word, start byte, end byte).

    Spans hold every word inside an occurrence of a window; byte positions are those of the
    UTF-8 text.  Null and empty texts have no words and no spans.  Extra columns pass through,
    but for older ones of the three names, which are replaced.
    """
    docs = docs.drop("n_words", "items", "spans")
    schema = docs.select(
        "*",
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast("array<struct<start:bigint,end:bigint,start_byte:bigint,end_byte:bigint>>").alias("spans"),
    ).schema
    place = docs.columns.index(text)
    kinds = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "end", "start_byte", "end_byte")]))

    def rows_of(texts: pa.Array, hasher: WordHasher, lower: np.ndarray) -> Iterator[tuple[int, list[str], list[dict[str, int]]]]:
        for _, _, data, offsets in chunks(texts):
            data = lower[data]
            starts, ends, first = word_spans(data, offsets, letters_and_digits())
            hit, window = shard_hits(data.tobytes(), starts, ends, hasher(data, starts, ends), first, windows)
            order = np.argsort(hit, kind="stable")
            hit, window = hit[order], window[order]
            cut = np.searchsorted(hit, first)
            for row in range(len(offsets) - 1):
                a, b = cut[row], cut[row + 1]
                names = (windows.item_ids[i] for n in set(window[a:b].tolist()) for i in windows.items[n])
                found = sorted({x for x in names if x is not None})
                spans = merged_spans(hit[a:b], hit[a:b] + windows.lengths[window[a:b]])
                yield (
                    int(first[row + 1] - first[row]),
                    found,
                    [
                        {
                            "start": int(s - first[row]),
                            "end": int(e - first[row]),
                            "start_byte": int(starts[s] - offsets[row]),
                            "end_byte": int(ends[e - 1] - offsets[row]),
                        }
                        for s, e in spans
                    ],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, lower = WordHasher(), lower_table()
        for batch in batches:
            rows = list(rows_of(batch.column(place), hasher, lower))
            counts, found, spans = zip(*rows, strict=True) if rows else ((), (), ())
            arrays = [*batch.columns, pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "n_words", "items", "spans"])

    return docs.mapInArrow(run, schema)


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Windows]:
    """The windows of the benchmark, in blocks of bounded size.

    Null ids are ignored as names but their windows count; repeated items count once per id.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // (block_words * 4)))
    for part in range(parts):
        here = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        # Bounded: one block of the test set, never the documents.
        table = here.toArrow()
        words = item_words(table.column("text")) if table.num_rows else []
        yield windows_of(list(zip(table.column("item_id").to_pylist(), words, strict=True)), window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text: str = "text") -> DataFrame:
    """``docs`` with n_words, items and spans over the whole benchmark; see :func:`removal_spans`."""
    out = None
    for windows in benchmark_blocks(benchmark, window, block_words):
        if out is None:
            out = removal_spans(docs, windows, text)
            continue
        before = out.withColumnsRenamed({"n_words": "_n", "items": "_items", "spans": "_spans"})
        out = removal_spans(before, windows, text).withColumns(
            {
                "items": F.array_sort(F.array_union("items", "_items")),
                "spans": merge_expression(F.array_sort(F.concat("spans", "_spans"))),
            }
        ).drop("_n", "_items", "_spans")
    return out


def merge_expression(spans):
    """Sorted spans with overlapping or touching ones made one."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint,start_byte:bigint,end_byte:bigint>>")

    def step(done, s):
        last = F.element_at(done, -1)
        joined = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
            last["start_byte"].alias("start_byte"), F.greatest(last["end_byte"], s["end_byte"]).alias("end_byte"),
        )
        touching = (F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"])
        return F.when(touching, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.array_append(done, s))

    return F.aggregate(spans, empty, step)


def without_spans(text, spans):
    """The text with the bytes of each span cut out."""
    raw = F.encode(text, "UTF-8")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end_byte"]))
    ends = F.concat(F.transform(spans, lambda s: s["start_byte"]), F.array(F.length(raw).cast("long")))
    kept = F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda x: F.decode(F.substring(raw, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")), "UTF-8"),
    )
    return F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(text)


def op3(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest columns."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )

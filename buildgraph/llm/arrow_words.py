"""Words of Arrow text columns as NumPy arrays of byte positions and hashes.

Everything works on the UTF-8 bytes of a batch: every separator is one ASCII
byte, so byte positions are enough and no Python string is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C13
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def byte_values() -> np.ndarray:
    """One random 64-bit value per byte, the same in every process."""
    return np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def space_separated() -> np.ndarray:
    """Which bytes belong to words that white space (0x20, 0x09-0x0D) separates."""
    table = np.ones(256, dtype=bool)
    table[0x20] = False
    table[0x09:0x0E] = False
    return table


def letters_and_digits() -> np.ndarray:
    """Which bytes belong to words of 0-9, a-z and everything beyond ASCII."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = True
    table[0x61:0x7B] = True
    table[0x80:] = True
    return table


def lower_table() -> np.ndarray:
    """Lower-cases A-Z and leaves every other byte."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column as (first row, end row, bytes, offsets); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row plus the total); words never cross rows."""
    inside = is_word[data]
    n = len(data)
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        after[-1] = False
        after[:-1] = inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class WordHasher:
    """64-bit hashes of byte ranges, all ranges of a chunk at once."""

    def __init__(self) -> None:
        self._values = byte_values()
        self._powers = np.ones(1, dtype=np.uint64)
        self._inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            self._powers = np.full(n, MULTIPLIER, dtype=np.uint64)
            self._inverses = np.full(n, INVERSE, dtype=np.uint64)
            self._powers[0] = self._inverses[0] = 1
            np.multiply.accumulate(self._powers, out=self._powers)
            np.multiply.accumulate(self._inverses, out=self._inverses)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(max(n, CHUNK_BYTES))
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self._values[data] * self._powers[:n], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self._inverses[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first word."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(MULTIPLIER) + words[i : i + count]
    return mixed(out)

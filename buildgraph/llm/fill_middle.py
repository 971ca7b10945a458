"""Fill-in-the-middle training texts: a document is cut twice and its middle moved to the end.

A text is laid out in blocks of ``BLOCK`` bytes.  A Fenwick tree over the blocks stores how
many units and how many code points start in each.  The block of a cut is found by binary
lifting from the root, which adds up the code points on its way; the cut itself is then looked
for in that block only.  Units are code points, words (with the white space after them) or
lines (with their line break); white space before the first word belongs to it.

Where a document is cut, whether it is left plain and the order of its pieces come from a hash of its
id, so a rerun gives the same rows.  Each text is worked on by itself, whatever its length; a
batch leaves a task in pieces of about a megabyte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildgraph.llm.arrow_words import chunks, space_separated

#: Bytes of a block.
BLOCK = 512
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
UNITS = ("char", "word", "line")


def unit_starts(data: np.ndarray, unit: str) -> np.ndarray:
    """Whether a unit starts at each byte of one text."""
    starts = np.zeros(len(data), dtype=bool)
    if not len(data):
        return starts
    if unit == "char":
        return (data & 0xC0) != 0x80
    if unit == "line":
        starts[1:] = data[:-1] == 0x0A
    else:
        inside = space_separated()[data]
        starts[1:] = inside[1:] & ~inside[:-1]
        # White space before the first word goes with it.
        starts[np.flatnonzero(inside)[:1]] = False
    starts[0] = True
    return starts


class BlockTree:
    """Fenwick tree over the blocks of one text: units and code points that start in each."""

    def __init__(self, data: np.ndarray, unit: str = "char", block: int = BLOCK):
        self.data, self.unit, self.block = data, unit, block
        self.starts = unit_starts(data, unit)
        chars = self.starts if unit == "char" else unit_starts(data, "char")
        self.chars = chars
        at = np.arange(0, len(data), block)
        self.size = len(at)
        self.tree = np.zeros((self.size + 1, 2), dtype=np.int64)
        if self.size:
            self.tree[1:, 0] = np.add.reduceat(self.starts, at, dtype=np.int64)
            self.tree[1:, 1] = np.add.reduceat(chars, at, dtype=np.int64)
        step = 1
        while 2 * step <= self.size:
            # Each node hands its sum to the node above it.
            above = self.tree[2 * step :: 2 * step]
            above += self.tree[step :: 2 * step][: len(above)]
            step *= 2
        self.units, self.code_points = self.total()

    def total(self) -> tuple[int, int]:
        """Units and code points of the text."""
        out = np.zeros(2, dtype=np.int64)
        i = self.size
        while i:
            out += self.tree[i]
            i &= i - 1
        return int(out[0]), int(out[1])

    def cut(self, units: int) -> tuple[int, int]:
        """(byte, code point) at which so many units end."""
        if units >= self.units:
            return len(self.data), self.code_points
        block, passed, chars = 0, 0, 0
        step = 1 << max(self.size.bit_length() - 1, 0)
        while step:
            if block + step <= self.size and passed + self.tree[block + step, 0] <= units:
                block += step
                passed += int(self.tree[block, 0])
                chars += int(self.tree[block, 1])
            step >>= 1
        lo = block * self.block
        here = np.flatnonzero(self.starts[lo : lo + self.block])[units - passed]
        return lo + int(here), chars + int(np.count_nonzero(self.chars[lo : lo + here]))


def draws(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document; a null id counts as an empty one."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def arranged(tree: BlockTree, doc_id: object, seed: int, rate: int, spm: int, marks: tuple[str, ...]) -> tuple:
    """(units, form, prefix and middle code points, output bytes) of one text."""
    raw = tree.data.tobytes()
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not raw or h3 % 100 >= rate or any(m.encode() in raw for m in marks):
        return tree.units, "plain", None, None, raw
    one, two = sorted((h1 % (tree.units + 1), h2 % (tree.units + 1)))
    (a, prefix), (b, upto) = tree.cut(one), tree.cut(two)
    p, s, m = (x.encode() for x in marks)
    if h4 % 100 < spm:
        form, out = "spm", (s, raw[b:], p, raw[:a], m, raw[a:b])
    else:
        form, out = "psm", (p, raw[:a], s, raw[b:], m, raw[a:b])
    return tree.units, form, prefix, upto - prefix, b"".join(out)


def fill_in_middle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    unit: str = "char",
    seed: int = 1,
    rate: int = 90,
    spm: int = 20,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): one row per row of ``docs``.

    ``rate`` percent of the documents are cut, ``spm`` percent of those with the suffix first.
    Null and empty texts are plain with an empty output and n = 0; so are texts that
    hold a mark, whole and unchanged.  Repeated rows give equal rows; rows of one id and
    different texts are cut at places drawn from equal hashes.  Other columns, whatever their names,
    are not read; an empty table gives an empty one.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo)
                found = [
                    arranged(BlockTree(data[offsets[i] : offsets[i + 1]], unit), d, seed, rate, spm, marks)
                    for i, d in enumerate(ids.to_pylist())
                ]
                columns = zip(*found, strict=True)
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *arrays], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The document's text, from an output and its form alone."""
    quoted = "|".join("\\Q" + m + "\\E" for m in marks)
    part = F.split(output, quoted, -1)
    moved = F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1]))
    return F.when(form == "plain", output).otherwise(moved)


def op11(docs: DataFrame) -> DataFrame:
    """The contract's digest columns."""
    out = fill_in_middle(docs)
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )

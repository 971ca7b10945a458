"""A data source that reads one JSON object by many tasks: the members that start in each byte range.

A document of any size is cut into ranges of equal length at arbitrary offsets.  What a byte means
depends on all bytes before it (inside a string, behind a backslash, how deep), so there are two passes:

* ``json_ranges``: each range says, for both possible escapes at its start, what it does to that state: whether
  it flips inside/outside of strings, and by how much the depth changes in either case;
* ``json_members``: these summaries, one small row per range, are chained from the start of each file, which
  gives the true state at every range; then each task emits the members whose leading brace or comma
  lies in its range, reading on past its end until the last one is complete.

No task holds more than a member and a chunk of bytes.  A lost task reads its range again.
"""

from __future__ import annotations

import json
import sys
import urllib.parse
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from buildgraph.functions.storage import fresh_path

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a range, and of what is looked at at once.
SPLIT_BYTES = 64 << 20
CHUNK_BYTES = 1 << 20
#: What opening a file counts as when small ranges are dealt to tasks.
OPEN_BYTES = 1 << 16
RANGES = "file string, start long, length long, size long, escapes array<int>, flips array<int>, deeper array<long>, seen boolean"
MEMBERS = "file string, at long, key string, value string, bad boolean"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a local path or a URI."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(urllib.parse.quote(path, safe=":/@"))


def chunks_of(path: str, start: int, stop: int) -> Iterator[bytes]:
    """The bytes from ``start`` to ``stop`` in chunks."""
    system, name = filesystem(path)
    with system.open_input_file(name) as f:
        f.seek(start)
        while start < stop:
            data = f.read(min(CHUNK_BYTES, stop - start))
            if not data:
                return
            start += len(data)
            yield data


@dataclass
class Lexed:
    """One chunk, for a start outside of strings: what each byte is."""

    inside: np.ndarray
    change: np.ndarray
    escape: int
    flip: int


def lex(data: np.ndarray, escape: int) -> Lexed:
    """``inside``: within a string, opening quotes not; ``change``: +1 and -1 for brackets of either kind.

    ``escape``: whether the first byte follows an open backslash.
    """
    at = np.arange(len(data))
    slash = data == 0x5C
    last_other = np.maximum.accumulate(np.where(slash, -1 - escape, at))
    before = np.concatenate([[-1 - escape], last_other[:-1]])
    escaped = (at - 1 - before) % 2 == 1
    quote = (data == 0x22) & ~escaped
    seen = np.cumsum(quote)
    inside = (seen - quote) % 2 == 1
    change = ((data == 0x7B) | (data == 0x5B)).astype(np.int8) - ((data == 0x7D) | (data == 0x5D)).astype(np.int8)
    return Lexed(inside, change, int((len(data) - 1 - last_other[-1]) % 2), int(seen[-1] % 2))


def summary(chunks: Iterator[bytes]) -> tuple[list[int], list[int], list[int], bool]:
    """What a range does to the state: for escape 0 and 1 at its start, the escape at its end, whether it
    changes inside to outside, and the change of depth from outside and from inside (four numbers)."""
    escapes, flips, deeper, seen = [0, 1], [0, 0], [[0, 0], [0, 0]], False
    for raw in chunks:
        data = np.frombuffer(raw, dtype=np.uint8)
        seen = seen or bool((~blank(data)).any())
        known: dict[int, tuple] = {}
        for e in (0, 1):
            if escapes[e] not in known:
                found = lex(data, escapes[e])
                total = int(found.change.sum(dtype=np.int64))
                outer = int(found.change[~found.inside].sum(dtype=np.int64))
                known[escapes[e]] = (found.escape, found.flip, outer, total - outer)
            escape, flip, outer, inner = known[escapes[e]]
            # A range that started inside sees the two the other way round; so does one that was flipped since.
            deeper[e][0] += inner if flips[e] else outer
            deeper[e][1] += outer if flips[e] else inner
            escapes[e] = escape
            flips[e] ^= flip
    return escapes, flips, [*deeper[0], *deeper[1]], seen


def blank(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | (data == 0x0A) | (data == 0x0D) | (data == 0x09)


@dataclass
class State:
    """The state before a byte: behind a backslash, inside a string, how deep, anything but blanks so far."""

    escape: int = 0
    inside: int = 0
    depth: int = 0
    seen: bool = False

    def after(self, row: dict) -> State:
        """The state behind a range with this summary."""
        e = self.escape
        depth = self.depth + row["deeper"][2 * e + self.inside]
        return State(row["escapes"][e], self.inside ^ row["flips"][e], depth, self.seen or row["seen"])


@dataclass
class Range(InputPartition):
    file: str
    start: int
    length: int
    size: int
    state: State | None = None
    broken: bool = False


@dataclass
class Task(InputPartition):
    """Ranges that one task reads."""

    parts: list[Range]


def dealt(ranges: list[Range], limit: int) -> list[Task]:
    """Ranges in their order, as many small ones a task as ``limit`` bytes hold: a task each would cost more than they do."""
    out: list[Task] = []
    room = 0
    for r in ranges:
        cost = r.length + OPEN_BYTES
        if not out or cost > room:
            out.append(Task([]))
            room = limit
        out[-1].parts.append(r)
        room -= cost
    return out or [Task([])]


def no_constant(name: str) -> None:
    raise ValueError(name)


def member(text: bytes) -> tuple[str, str]:
    """(key, value as JSON text) of one member; a ValueError if it is not one."""
    s = text.decode("utf-8").strip(" \t\r\n")
    if not s.startswith('"'):
        raise ValueError("no key")
    key, end = json.decoder.scanstring(s, 1, True)
    rest = s[end:].lstrip(" \t\r\n")
    if not rest.startswith(":"):
        raise ValueError("no colon")
    value = rest[1:].strip(" \t\r\n")
    json.loads(value, parse_constant=no_constant)
    return key, value


def members_of(part: Range) -> Iterator[tuple[int, str | None, str | None, bool]]:
    """(place, key, value, bad) of the members whose leading brace or comma lies in the range.

    ``bad`` rows say that the document is not one JSON object.
    """
    state = State(**vars(part.state))
    at, end = part.start, part.start + part.length
    held: list[bytes] = []  # the open member so far
    opened = None  # the place behind its leading brace or comma
    first = False  # whether that was the brace
    for raw in chunks_of(part.file, part.start, part.size):
        if at >= end and opened is None:
            return
        data = np.frombuffer(raw, dtype=np.uint8)
        found = lex(data, state.escape)
        outside = found.inside if state.inside else ~found.inside
        change = np.where(outside, found.change, 0)
        total = np.cumsum(change, dtype=np.int64)
        depth = state.depth + total - change
        top = np.flatnonzero(outside & (depth <= 0) & ~blank(data))
        for i in top[top + at < end]:
            if state.seen or data[i] != 0x7B:
                yield at + int(i), None, None, True
            state.seen = True
        marks = np.flatnonzero(outside & (((depth == 0) & (data == 0x7B)) | ((depth == 1) & ((data == 0x2C) | (change < 0)))))
        copied = 0
        for i in marks.tolist():
            byte = raw[i]
            if opened is not None:
                held.append(raw[copied:i])
                text = b"".join(held)
                held = []
                if not (first and byte == 0x7D and not text.strip(b" \t\r\n")):
                    try:
                        yield (opened, *member(text), byte == 0x5D)
                    except (ValueError, RecursionError):
                        yield opened, None, None, True
                opened = None
            if byte == 0x7B or byte == 0x2C:
                if at + i >= end:
                    return
                opened, first, copied = at + i + 1, byte == 0x7B, i + 1
        if opened is not None:
            held.append(raw[copied:])
        state.depth += int(total[-1])
        state.inside ^= found.flip
        state.escape = found.escape
        at += len(raw)
    if opened is not None:
        yield opened, None, None, True


def stored_rows(path: str) -> list[dict]:
    """The rows of a small stored table, read on the driver."""
    system, name = filesystem(path)
    return pads.dataset(name, filesystem=system, format="parquet").to_table().to_pylist()


class RangeReader(DataSourceReader):
    """Summaries of the byte ranges of the files in a stored listing (path, length)."""

    def __init__(self, options: dict):
        self.files, self.split = options["files"], int(options["split"])

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for row in stored_rows(self.files):
            size = row["length"]
            out += [Range(row["path"], at, min(self.split, size - at), size) for at in range(0, max(size, 1), self.split)]
        return dealt(out, self.split // 8)

    def read(self, task: Task) -> Iterator[tuple]:
        for part in task.parts:
            yield (part.file, part.start, part.length, part.size, *summary(chunks_of(part.file, part.start, part.start + part.length)))


class MemberReader(DataSourceReader):
    """Members by byte range, from the stored summaries of all ranges."""

    def __init__(self, options: dict):
        self.ranges, self.split = options["ranges"], int(options.get("split", SPLIT_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        out: list[Range] = []
        rows = sorted(stored_rows(self.ranges), key=lambda r: (r["file"], r["start"]))
        state = State()
        for i, row in enumerate(rows):
            if not row["start"]:
                state = State()
            here = Range(row["file"], row["start"], row["length"], row["size"], state)
            state = state.after(row)
            if i + 1 == len(rows) or not rows[i + 1]["start"]:
                here.broken = bool(state.escape or state.inside or state.depth or not state.seen)
            out.append(here)
        return dealt(out, self.split // 8)

    def read(self, task: Task) -> Iterator[pa.RecordBatch]:
        for part in task.parts:
            yield from self.batches(part)

    def batches(self, part: Range) -> Iterator[pa.RecordBatch]:
        names = ["at", "key", "value", "bad"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()]
        rows: list[tuple] = [(part.size, None, None, True)] if part.broken else []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([part.file] * len(rows)), *columns], ["file", *names])

        for row in members_of(part):
            rows.append(row)
            held += len(row[2] or "")
            if len(rows) == 4096 or held > CHUNK_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class JsonRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self) -> str:
        return RANGES

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(dict(self.options))


class JsonMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return MemberReader(dict(self.options))


def read_members(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, at, key, value, bad): the members of the JSON objects below ``path``, values as JSON text.

    ``at`` is the byte behind a member's leading brace or comma.  Rows with ``bad`` mark files that are not one JSON object and
    nothing else; a file without such a row is one.  Files are listed by Spark, and read by
    byte ranges of ``split_bytes``.  The driver holds one small row per range, as it does for any scan.
    """
    spark.dataSource.register(JsonRanges)
    spark.dataSource.register(JsonMembers)
    files = fresh_path(spark, "json-files")
    # Only names and lengths: the contents are not read here.
    spark.read.format("binaryFile").load(path).select("path", "length").write.parquet(files)
    ranges = fresh_path(spark, "json-ranges")
    source = spark.read.format("json_ranges").option("files", files).option("split", str(split_bytes)).load()
    source.write.parquet(ranges)
    return spark.read.format("json_members").option("ranges", ranges).option("split", str(split_bytes)).load()

"""A streaming source of log lines with their true place: (file, byte offset).

The offset of the stream is, for each file, the byte up to which its lines are read; it always lies behind a line
break, so a line that is still being written counts once it is complete, and a file that grows is read on where it
was left.  What lies between two offsets is cut into byte ranges, and each range gives the lines that start in it.
A batch that runs again reads the same bytes, and a line has the same place however the file is cut.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from buildgraph.sources.json_members import SPLIT_BYTES, chunks_of, filesystem

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINES = "value string, run string, seq bigint"
TAIL_BYTES = 1 << 16


def list_files(pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that match or lie in a folder that does; names starting with _ or . are skipped."""
    system, name = filesystem(pattern)
    parts = name.rstrip("/").split("/")
    fixed = next((i for i, p in enumerate(parts) if "*" in p), len(parts))
    base = "/".join(parts[:fixed]) or "/"
    wanted = re.compile("/".join(".*".join(map(re.escape, p.split("*"))).replace(".*", "[^/]*") for p in parts) + "(/.*)?$")
    info = system.get_file_info(base)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)]
    found = system.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    files = [f for f in found if f.type == pafs.FileType.File and wanted.match(f.path)]
    return sorted((f.path, f.size) for f in files if not re.search(r"/[_.]", f.path[len(base) :]))


def last_line_end(pattern: str, name: str, start: int, size: int) -> int:
    """The place behind the last line break between two bytes; ``start`` if there is none."""
    system, _ = filesystem(pattern)
    with system.open_input_file(name) as f:
        stop = size
        while stop > start:
            at = max(start, stop - TAIL_BYTES)
            f.seek(at)
            found = f.read(stop - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            stop = at
    return start


@dataclass
class LineRange(InputPartition):
    """The lines that start from ``lo`` to ``hi``, among the bytes from ``start`` to ``stop``."""

    file: str
    start: int
    stop: int
    lo: int
    hi: int


def lines_of(part: LineRange) -> Iterator[tuple[str, int]]:
    """(line, place) of the lines that start in the range."""
    # A range that starts within the batch's bytes looks one byte back: a break there starts a line.
    inner = part.lo > part.start
    at = part.lo - inner
    skip, held, begin = inner, [], at
    for raw in chunks_of(part.file, at, part.stop):
        copied = 0
        while (end := raw.find(b"\n", copied)) >= 0:
            if not skip:
                held.append(raw[copied:end])
                yield b"".join(held).removesuffix(b"\r").decode("utf-8", "replace"), begin
            held, skip, copied = [], False, end + 1
            begin = at + copied
            if begin >= part.hi:
                return
        if not skip:
            held.append(raw[copied:])
        at += len(raw)
    if not skip and begin < part.hi and any(held):
        yield b"".join(held).removesuffix(b"\r").decode("utf-8", "replace"), begin


class LineReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("split", SPLIT_BYTES))
        #: Whether files are complete: then a last line without a break counts, too.
        self.complete = options.get("complete", "false") == "true"
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        for name, size in list_files(self.path):
            before = self.seen.get(name, 0)
            if size > before:
                self.seen[name] = size if self.complete else last_line_end(self.path, name, before, size)
        return {"files": {n: b for n, b in self.seen.items() if b}}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for name, stop in end["files"].items():
            first = start["files"].get(name, 0)
            prefix = self.path.split("://", 1)[0] + "://" if "://" in self.path and not self.path.startswith("file:") else ""
            out += [LineRange(prefix + name, first, stop, lo, min(lo + self.split, stop)) for lo in range(first, stop, self.split)]
        return out

    def read(self, part: LineRange) -> Iterator[pa.RecordBatch]:
        run = part.file if "://" in part.file else "file://" + part.file
        rows: list[tuple[str, int]] = []

        def batch() -> pa.RecordBatch:
            values, places = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([run] * len(rows)), pa.array(places, pa.int64())], ["value", "run", "seq"])

        for row in lines_of(part):
            rows.append(row)
            if len(rows) == 4096:
                yield batch()
                rows = []
        if rows:
            yield batch()

    def commit(self, end: dict) -> None:
        pass


class LogLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LineReader(dict(self.options))


def stream_lines(spark: SparkSession, path: str, complete: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(value, run, seq) of the lines below ``path``, which may hold *; ``seq`` is a line's first byte in its file."""
    spark.dataSource.register(LogLines)
    source = spark.readStream.format("log_lines").option("path", path).option("split", str(split_bytes))
    return source.option("complete", str(complete).lower()).load()

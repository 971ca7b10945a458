"""Results documents of any size: a sink that streams them into fragments, and their reader.

A document is a folder ``results-<system>.json`` whose files, joined in name order, are the JSON text:
a head up to ``"targets":[``, fragments of targets in order with one target a line, a comma
between two fragments, and the end.  Rows come sorted by range, so a task holds the open
fragment of one system at a time and never a whole document.

Tasks write below a folder of this job.  On commit the driver, which knows the fragments by their
messages only, moves those of successful tasks into place and writes heads and ends; files of failed or
repeated attempts stay behind in the job's folder, which goes with it.  On abort nothing else was written.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from buildgraph.sources import schemas
from buildgraph.sources.json_members import filesystem

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIELDS = ["tree_path", "drv_path", "dev_attr_type", "status", "duration_ms", "exit_code", "owners", "log_tail"]
HEAD = "system string, branch string, commit string, success boolean"


@dataclass
class Fragment:
    """Targets of one system that one task wrote."""

    system: str | None
    task: int
    path: str
    succeeded: bool


@dataclass
class Written(WriterCommitMessage):
    fragments: list[Fragment] = field(default_factory=list)


def document_name(system: str | None) -> str:
    """The folder of a system; an empty and a missing one stay apart."""
    return "results-" + ("none" if system is None else "s-" + quote(system, safe="")) + ".json"


class DocumentWriter(DataSourceWriter):
    """Rows (system, succeeded, json), sorted by system within and across tasks, as documents."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.branch, self.commit_id = options.get("branch"), options.get("commit")
        self.overwrite = overwrite
        self.job = f"{self.path}/.job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, _ = filesystem(self.path)
        task = TaskContext.get().partitionId()
        out = Written()
        open_file = None
        try:
            for row in iterator:
                if not out.fragments or out.fragments[-1].system != row.system:
                    if open_file:
                        open_file.close()
                    # A name of its own for every attempt.
                    name = f"{self.job}/{task:08d}-{len(out.fragments)}-{uuid.uuid4().hex}"
                    system.create_dir(filesystem(self.job)[1])
                    open_file = system.open_output_stream(filesystem(name)[1], buffer_size=1 << 20)
                    out.fragments.append(Fragment(row.system, task, name, True))
                else:
                    open_file.write(b",\n")
                out.fragments[-1].succeeded &= row.succeeded
                open_file.write(row.json.encode())
        finally:
            if open_file:
                open_file.close()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        system, root = filesystem(self.path)
        documents: dict[str | None, list[Fragment]] = {}
        for message in messages:
            for fragment in message.fragments if message else []:
                documents.setdefault(fragment.system, []).append(fragment)
        for info in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith("results-"):
                if not self.overwrite:
                    raise FileExistsError(info.path)
                system.delete_dir(info.path)
        for name, fragments in documents.items():
            folder = f"{root}/{document_name(name)}"
            system.create_dir(folder)
            head = {"system": name, "branch": self.branch, "commit": self.commit_id, "success": all(f.succeeded for f in fragments)}
            self.put(system, f"{folder}/0-head", json.dumps(head)[:-1] + ', "targets": [\n')
            for i, f in enumerate(sorted(fragments, key=lambda f: f.task)):
                if i:
                    self.put(system, f"{folder}/1-{f.task:08d}-0-comma", ",\n")
                system.move(filesystem(f.path)[1], f"{folder}/1-{f.task:08d}-1-targets")
            # The end comes last: a folder without it is no document.
            self.put(system, f"{folder}/2-end", "\n]}\n")
        self.clear(system)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(filesystem(self.path)[0])

    @staticmethod
    def put(system: pafs.FileSystem, path: str, text: str) -> None:
        with system.open_output_stream(path) as f:
            f.write(text.encode())

    def clear(self, system: pafs.FileSystem) -> None:
        folder = filesystem(self.job)[1]
        if system.get_file_info(folder).type == pafs.FileType.Directory:
            system.delete_dir(folder)


class ResultDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "result_documents"

    def schema(self) -> str:
        return "system string, succeeded boolean, json string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(dict(self.options), overwrite)


def succeeded(status: Column) -> Column:
    """Whether a target counts as succeeded; an unknown status does not."""
    return F.coalesce(status == "succeeded", F.lit(False))


def write_result_documents(
    results: DataFrame, path: str, branch: str | None = None, commit: str | None = None, mode: str = "append", tasks: int | None = None
) -> None:
    """Write one results document per system below ``path``, targets in order of tree_path.

    A system may hold any number of targets: its rows are dealt to tasks by ranges of (system, tree_path).
    With mode ``append`` a folder that already holds documents is an error and stays as it is; ``overwrite``
    replaces all its documents.  ``success`` is false if any target's status is null or not ``succeeded``.
    """
    spark = results.sparkSession
    spark.dataSource.register(ResultDocuments)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})
    rows = results.select("system", "tree_path", succeeded(F.col("status")).alias("succeeded"), body.alias("json"))
    order = ["system", "tree_path", "json"]
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("system", "succeeded", "json")
    out = rows.write.format("result_documents").mode(mode).option("path", path)
    for name, value in (("branch", branch), ("commit", commit)):
        if value is not None:
            out = out.option(name, value)
    out.save()


def read_result_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the documents below ``path`` with system, branch, commit and success of their heads.

    Fragments are read line by line, so large ones are split; a broken line is an error.
    """
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    whole = spark.read.text(f"{path}/results-*.json/0-head", wholetext=True)
    head = whole.select(folder.alias("_d"), F.from_json(F.concat("value", F.lit("]}")), HEAD).alias("h")).select("_d", "h.*")
    lines = spark.read.text(f"{path}/results-*.json/1-*-targets").select(folder.alias("_d"), "value")
    parsed = lines.select("_d", F.from_json(F.regexp_replace("value", ",$", ""), schemas.RESULT_TARGET, {"mode": "FAILFAST"}).alias("t"))
    rows = parsed.join(head, "_d")
    status = F.when(F.col("t.status").isin("succeeded", "failed", "skipped"), F.col("t.status")).otherwise("unknown")
    kept = {c: F.col(f"t.{c}") for c in FIELDS} | {"status": status}
    kept["owners"] = F.coalesce("t.owners", F.array().cast(schemas.OWNERS))
    return rows.select("system", "branch", "commit", "success", *[c.alias(n) for n, c in kept.items()])

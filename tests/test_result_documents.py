"""Results documents streamed into fragments."""

import json
import os

import pytest
from pyspark.sql import functions as F

from buildgraph.plans import files
from buildgraph.sources import readers as rd
from buildgraph.sources import result_documents as docs
from buildgraph.sources import schemas

ROW = (
    "system string, tree_path string, drv_path string, dev_attr_type string, status string, duration_ms bigint, "
    f"exit_code bigint, owners {schemas.OWNERS}, log_tail string"
)


def results(spark, n=200):
    states = ["succeeded", "succeeded", "succeeded"]
    rows = [("hot" if i % 4 else f"s/{i % 3}", f"t{i:04}", f"/d/{i}", "x", states[i % 3], i, 0, [], 'a\n"b",\n]}') for i in range(n)]
    rows += [(None, "n", None, None, "succeeded", 1, 0, None, None), ("", "e", None, None, "failed", 1, 1, [("d", "g")], "x"), ("odd", "a", "d", "t", None, 1, None, None, None)]
    rows += [rows[5]] * 3
    return spark.createDataFrame(rows, ROW)


def test_documents_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    table = results(spark)
    docs.write_result_documents(table, path, "main", "c0", tasks=7)
    want = table.withColumns({"status": rd.status_or_unknown(F.col("status")), "owners": F.coalesce("owners", F.array().cast(schemas.OWNERS))})
    got = docs.read_result_documents(spark, path)
    names = ["system", *docs.FIELDS]
    assert sorted(map(repr, got.select(names).collect())) == sorted(map(repr, want.select(names).collect()))
    assert {(r.branch, r.commit) for r in got.collect()} == {("main", "c0")}
    success = {r.system: r.success for r in got.select("system", "success").distinct().collect()}
    # A null status is no success.
    assert success == {"hot": True, "s/0": True, "s/1": True, "s/2": True, None: True, "": False, "odd": False}
    assert not [n for n in os.listdir(path) if n.startswith(".job")]
    hot = os.listdir(f"{path}/results-s-hot.json")
    assert sum(n.endswith("targets") for n in hot) > 3
    whole = {}
    for name in os.listdir(path):
        files_of = sorted(n for n in os.listdir(f"{path}/{name}") if not n.startswith("."))
        doc = json.loads("".join(open(f"{path}/{name}/{f}").read() for f in files_of))
        whole[doc["system"]] = [t["tree_path"] for t in doc["targets"]]
    assert set(whole) == set(success) and all(v == sorted(v) for v in whole.values())
    # The joined text is a document for the plain reader, too.
    joined = tmp_path / "joined"
    joined.mkdir()
    folder = f"{path}/results-s-hot.json"
    (joined / "results-hot.json").write_text("".join(open(f"{folder}/{f}").read() for f in sorted(hot) if not f.startswith(".")))
    assert rd.read_results(spark, str(joined)).count() == len(whole["hot"])


def test_documents_are_not_mixed_with_older_ones(spark, tmp_path):
    path = str(tmp_path / "out")
    table = results(spark, 20)
    docs.write_result_documents(table, path, "main", "c0")
    before = sorted(map(repr, docs.read_result_documents(spark, path).collect()))
    with pytest.raises(Exception, match="results-"):
        docs.write_result_documents(table.limit(2), path)
    assert sorted(map(repr, docs.read_result_documents(spark, path).collect())) == before
    docs.write_result_documents(table.where("system = 'hot'"), path, mode="overwrite")
    assert [r.system for r in docs.read_result_documents(spark, path).select("system").distinct().collect()] == ["hot"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    table = results(spark).withColumn("exit_code", F.when(F.col("tree_path") == "t0150", F.raise_error(F.lit("boom")).cast("bigint")).otherwise(F.col("exit_code")))
    with pytest.raises(Exception, match="boom"):
        docs.write_result_documents(table, path, tasks=5)
    assert not os.path.exists(path) or os.listdir(path) == []


def test_the_number_of_documents_follows_the_table(spark):
    for n in (1, 25_000, 100_000):
        rows = spark.range(n)
        blocks = rows.select(files.block(rows, "id").alias("b")).distinct().count()
        assert blocks == -(-n // files.DOCUMENT_ROWS)

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from buildgraph.functions.storage import work_dir
from buildgraph.operators import diff as d
from buildgraph.operators.chunking import first_match
from buildgraph.sources import readers as rd
from buildgraph.sources import writers as wr


def test_snapshots(spark, tmp_path, rows):
    doc = {"a/b": {"drvPath": "/d/1", "attrPath": ["a", "b"], "system": "x", "owners": [{"github": "g"}], "outputs": {"out": "/o"}, "extra": 1}, "c": {"drvPath": "/d/2"}}
    (tmp_path / "head.json").write_text(json.dumps(doc, indent=1))
    df = rd.read_snapshots(spark, str(tmp_path))
    assert rows(df, "snapshot_id", "tree_path", "drv_path", "system") == [("head", "a/b", "/d/1", "x"), ("head", "c", "/d/2", None)]
    bare = df.filter("tree_path = 'c'").first()
    assert (bare["owners"], bare["deps"], bare["outputs"]) == ([], [], {})
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception, match="malformed document"):
        rd.read_snapshots(spark, str(tmp_path)).collect()
    assert rd.read_snapshots(spark, str(tmp_path), "quarantine").count() == 2
    assert rd.read_snapshots(spark, str(tmp_path), "quarantine", quarantined=True).count() == 1
    out = str(tmp_path / "out")
    wr.write_snapshot(df, d.changed_targets(df.filter("tree_path = 'c'"), df), out)
    assert spark.read.parquet(out + "/full").count() == 2
    assert rows(spark.read.parquet(out + "/changed"), "tree_path") == [("a/b",)]
    member = wr.snapshot_json(df.filter("tree_path = 'a/b'")).first()["json"]
    assert json.loads(member)["drvPath"] == "/d/1"


def test_results(spark, tmp_path, rows):
    doc = {"system": "x", "branch": "b", "commit": "c", "success": False, "targets": [
        {"tree_path": "t", "status": "failed", "exit_code": 1, "owners": [{"discord": None, "github": "g"}]},
        {"tree_path": "u", "status": "building"}]}
    (tmp_path / "results-x.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "other.json").write_text("nonsense")
    assert rows(rd.read_results(spark, str(tmp_path)), "tree_path", "status", "exit_code") == [("t", "failed", 1), ("u", "unknown", None)]
    (tmp_path / "none").mkdir()
    assert rd.read_results(spark, str(tmp_path / "none")).count() == 0
    out = str(tmp_path / "out")
    wr.write_results(rd.read_results(spark, str(tmp_path), "results-x.json"), out)
    assert rows(rd.read_result_rows(spark, out), "system", "tree_path", "status") == [("x", "t", "failed"), ("x", "u", "unknown")]
    assert rows(spark.read.json(out + "/summary"), "system", "success") == [("x", False)]


def test_pins(spark, tmp_path, rows):
    defs = tmp_path / "defs"
    for name, text in {
        "b": 'mkPackage {\n pname = "b";\n srcHash = "s";\n npmDepsHash = "n";\n}',
        "a": 'mkPackage {\n pname = "x";\n npmName = "@s/x";\n srcHash = "s";\n npmDepsHash = "n";\n}',
        "host": "other",
        "unpinned": 'mkPackage {\n pname = "u";\n srcHash = "s";\n npmDepsHash = "n";\n}',
    }.items():
        (defs / name).mkdir(parents=True)
        (defs / name / "default.nix").write_text(text)
    (tmp_path / "versions.json").write_text('{"@s/x": "1", "b": "2", "gone": "3"}')
    args = (str(tmp_path / "versions.json"), str(defs / "*"), "mkPackage")
    got = rd.read_pins(spark, *args)
    assert [(r["dir_name"], r["npm_name"], r["pinned_version"]) for r in got.collect()] == [("a", "@s/x", "1"), ("b", "b", "2")]
    (defs / "b" / "default.nix").write_text('mkPackage {\n pname = "b";\n}')
    with pytest.raises(Exception, match="no srcHash"):
        rd.read_pins(spark, *args).collect()


def page(*builds):
    return json.dumps({"data": {"pipeline": {"builds": {"edges": [{"node": b} for b in builds]}}}})


def build(commit, *artifacts):
    arts = [{"node": {"path": p, "downloadURL": u}} for p, u in artifacts]
    return {"commit": commit, "jobs": {"edges": [{"node": {"artifacts": {"edges": arts}}}]}}


def test_api_pages(spark, tmp_path, rows):
    texts = {
        "hit": page(build("old", ("m.json", "u0")), {"commit": "c"}, build("c", ("x", "u1"), ("m.json", "u2")), build("c", ("m.json", "u3"))),
        "none": page(build("d", ("m.json", "u4"))),
        "null": '{"data": null}',
        "errors": '{"errors": [{"message": "no"}]}',
        "late": page(*[build("z") for _ in range(50)], build("c", ("m.json", "u5"))),
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    pages = rd.read_api_pages(spark, str(tmp_path))
    wanted = spark.createDataFrame([("c",)], "commit string")
    for most, found in ((None, ["u2", "u5"]), (50, ["u2"])):
        flat = rd.flatten_artifacts(pages, max_builds=most, commits=wanted)
        got = first_match(flat, wanted, "m.json", ["file"])
        assert sorted(r["download_url"] for r in got.collect()) == found


def test_lockfiles(spark, tmp_path, rows):
    doc = {"packages": {"": {"name": "root"}, "node_modules/a/node_modules/@s/b": {"version": "1", "integrity": ""}, "odd": 3, "node_modules/c": {"resolved": "r"}}}
    (tmp_path / "package-lock.json").write_text(json.dumps(doc, indent=2))
    got = rd.read_lockfiles(spark, str(tmp_path))
    assert rows(got, "name", "version", "has_integrity") == sorted([("", None, False), ("@s/b", "1", True), ("c", None, False)], key=lambda t: tuple(map(repr, t)))


@pytest.mark.parametrize("text,want", [
    ("root=/r\ntarget=t.x\n", [("root", "/r", None), ("target", "t.x", None)]),
    ("legacy.target\n", [("target", "legacy.target", None)]),
    ("# c\n\n  target = t \n", [("target", "t", None)]),
    ("target=ok\nfoo=bar\n", [("foo", None, "unexpected line 'foo=bar'"), ("target", "ok", None)]),
    ("one\ntwo\n", [("target", "one", None)]),
    ("one\ntarget=k\ntarget=l=m\ntwo\n", [("target", "l=m", None)]),
])
def test_kv_files(spark, tmp_path, rows, text, want):
    (tmp_path / "target").write_text(text)
    assert rows(rd.read_kv_configs(spark, str(tmp_path)), "key", "value", "error") == want


def test_size_settings():
    assert [rd._bytes(s) for s in ("4194304", "128m", "1GB", "2kb", "134217728b")] == [4194304, 1 << 27, 1 << 30, 2048, 1 << 27]


def test_kv_configs_of_a_bundle(spark, rows, tmp_path):
    texts = {"a": "# x\nroot = /r\n\nt1", "b": "bare\rtarget=u\r\nodd=1", "c": "", "d": None}
    files = spark.createDataFrame(list(texts.items()), "file string, text string")
    wr.write_bundle(files, str(tmp_path / "bundle"))
    for name, text in texts.items():
        (tmp_path / "plain").mkdir(exist_ok=True)
        (tmp_path / "plain" / name).write_bytes((text or "").encode())
    got, want = (rd.read_kv_configs(spark, str(tmp_path / k), bundled=k == "bundle") for k in ("bundle", "plain"))
    columns = ("key", "value", "error")
    assert rows(got, *columns) == rows(want, *columns)
    assert got.select("file").distinct().count() == 2


def test_settings_are_not_a_folder_each(spark, tmp_path, rows):
    spark.range(300).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    before = set(os.listdir(work_dir(spark))) if os.path.isdir(work_dir(spark)) else set()
    assert entry.queries()["read_kv_configs"](spark, str(tmp_path)).count() == 675
    (made,) = set(os.listdir(work_dir(spark))) - before
    assert len(os.listdir(os.path.join(work_dir(spark), made))) < 50


def test_pins_and_pages_are_not_a_folder_each(spark, tmp_path):
    spark.range(300).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(18000).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    item = spark.range(18000).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(2).alias("l_partkey"), F.lit("R").alias("l_returnflag"))
    item.write.parquet(str(tmp_path / "lineitem.parquet"))
    for name, n in (("read_pins", 240), ("read_api_pages", 18000)):
        before = set(os.listdir(work_dir(spark))) if os.path.isdir(work_dir(spark)) else set()
        assert entry.queries()[name](spark, str(tmp_path)).count() == n
        made = set(os.listdir(work_dir(spark))) - before
        assert made and all(len(os.listdir(os.path.join(work_dir(spark), x))) < 50 for x in made)

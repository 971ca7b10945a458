"""No size, round or batch limit changes a result."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from buildgraph.functions.skew import hot_keys
from buildgraph.functions.storage import bucketed, fresh_path
from buildgraph.functions.text import valid_json
from buildgraph.operators.chunking import keep_set
from buildgraph.operators.extract import extract_between
from buildgraph.operators.graph import closure, nearest_known
from buildgraph.operators.lookup import lookup_chain
from buildgraph.plans import tables as t
from buildgraph.sources import readers as rd
from buildgraph.sources import writers as wr
from buildgraph.streaming import keyed
from buildgraph.streaming import log as sl

BIG = 18 * 1024 * 1024


@pytest.fixture(scope="module")
def big():
    """A valid object of more than 16 MiB in many members."""
    return json.dumps({f"key{i}": "x" * 1000 for i in range(BIG // 1000)})


def test_json_of_any_size_is_judged_alike(spark, big, tmp_path):
    table = spark.createDataFrame([(1, big), (2, big[:-1]), (3, big + "]"), (4, "1, 2"), (5, "null"), (6, "")], "k int, text string")
    got = {r.k: r.ok for r in table.select("k", valid_json("text").alias("ok")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}
    line = '@nix {"action":"msg","msg":"m","fields":["%s"]}' % ("y" * BIG)
    (tmp_path / "a.log").write_text(line + "\n")
    assert [r.action for r in rd.read_build_log(spark, str(tmp_path)).select("action").collect()] == ["msg"]
    (tmp_path / "s").mkdir()
    target = {"drvPath": "d", "attrPath": ["a"], "system": "x", "outputs": {f"o{i}": "z" * 1000 for i in range(BIG // 1000)}}
    (tmp_path / "s" / "one.json").write_text(json.dumps({"a/b": target}))
    snap = rd.read_snapshots(spark, str(tmp_path / "s"))
    assert [(r.tree_path, r.n) for r in snap.select("tree_path", F.size("outputs").alias("n")).collect()] == [("a/b", BIG // 1000)]
    requests = spark.createDataFrame([("c", "v")], "commit string, validator string")
    entries = spark.createDataFrame([("c", "v", big)], "commit string, validator string, payload string")
    assert lookup_chain(requests, [("disk", entries)]).first().origin == "disk"


def test_log_lines_around_the_marker(spark):
    texts = [
        '@nix {"action":"msg","msg":"has @end@ inside"}', '@nix {"action":"start","id":1},{"@end@":1}]', '@nix {"action":"start"} x',
        '@nix {"action":"start","id":2}', "@nix 7", "other",
    ]
    lines = spark.createDataFrame([(x,) for x in texts], "value string")
    got = rd.parse_log_lines(lines, "quarantine").select("action", "id", "msg").collect()
    assert sorted(map(str, map(tuple, got))) == ["('msg', None, 'has @end@ inside')", "('start', 2, None)"]
    assert rd.malformed_log_lines(lines).count() == 2


def test_null_ids_and_seeds(spark, rows):
    pairs = [("a", "b"), ("b", None), (None, "a"), ("b", "c"), ("c", "k"), ("x", "y"), ("y", "k"), ("k", "z")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    seeds = spark.createDataFrame([("a",), (None,)], "id string")
    assert rows(closure(edges, seeds), "id") == [("a",), ("b",), ("c",), ("k",), ("z",)]
    nodes = spark.createDataFrame([("k", True), ("z", True), ("a", True), (None, True)], "id string, known boolean")
    every = rows(nearest_known(edges, nodes), "src", "dep")
    some = rows(nearest_known(edges, nodes, seeds=seeds), "src", "dep")
    assert some == [r for r in every if r[0] == "a"] == [("a", "k")]


def test_nearest_known_nodes_read_once_are_not_stored(spark, rows):
    pairs = [("k", "a"), ("k", "b"), ("a", "z"), ("b", "z"), ("k", "z"), ("b", "y"), ("u", "a")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = spark.createDataFrame([("k", True), ("z", True), ("y", True)], "id string, known boolean")
    kept, passed = nearest_known(edges, nodes), nearest_known(edges, nodes, stored=False)
    want = [("a", "z"), ("b", "y"), ("b", "z"), ("k", "y"), ("k", "z"), ("u", "z")]
    assert rows(kept, "src", "dep") == rows(passed, "src", "dep") == want
    assert any("/nearest-" in f for f in kept.inputFiles()) and len(kept.inputFiles()) != len(passed.inputFiles())


def test_a_long_chain_has_no_round_limit(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(25)], "src string, dst string")
    seeds = spark.createDataFrame([("n0",)], "id string")
    assert closure(edges, seeds).count() == 26
    with pytest.raises(RuntimeError):
        closure(edges, seeds, max_rounds=5)


def test_pieces_of_a_hot_key_stay_small(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("k"))
    assert [tuple(r) for r in hot_keys(rows, ["k"], min_rows=30).collect()] == [(1, 14)]


def test_keep_set_of_a_large_n(spark, rows):
    commits = [("r", i, i // 2 if i % 5 else None, i) for i in range(40)]
    table = spark.createDataFrame(commits, "repo string, sha int, commit_time int, position int")
    from buildgraph.operators import chunking

    small = rows(keep_set(table, 7), "sha")
    before, chunking.RANKED = chunking.RANKED, 0
    try:
        assert rows(keep_set(table, 7), "sha") == small
    finally:
        chunking.RANKED = before


def test_empty_and_missing_systems_stay_apart(spark, rows, tmp_path):
    data = [("", "a", "succeeded"), (None, "b", "failed"), ("x/y", "c", "succeeded")]
    table = spark.createDataFrame(data, "system string, tree_path string, status string")
    wr.write_results(table, str(tmp_path / "out"), branch="main", commit="c0")
    back = rd.read_result_rows(spark, str(tmp_path / "out"))
    assert rows(back, "system", "tree_path", "branch", "commit") == sorted(
        [("", "a", "main", "c0"), (None, "b", "main", "c0"), ("x/y", "c", "main", "c0")], key=lambda r: tuple(map(repr, r))
    )
    assert spark.read.json(str(tmp_path / "out" / "summary")).count() == 3


def test_only_committed_batches_count(spark, rows):
    root = fresh_path(spark, "stream")
    source = fresh_path(spark, "lines")
    spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "k string, ts_us long, seq long").write.parquet(source)
    stream = spark.readStream.schema("k string, ts_us long, seq long").parquet(source)
    sl.throttle_stream(stream, root, "k", 1).awaitTermination()
    want = rows(keyed.output(spark, root))
    assert len(want) == 1
    # Files that a batch left behind without finishing are not part of the output.
    late = spark.createDataFrame([("late", 9, 9, False)], keyed.output(spark, root).schema)
    path = fresh_path(spark, "late")
    late.coalesce(1).write.parquet(path)
    stray = next(n for n in os.listdir(path.removeprefix("file:")) if n.endswith(".parquet"))
    shutil.copy(f"{path.removeprefix('file:')}/{stray}", f"{root.removeprefix('file:')}/output/{stray}")
    assert rows(keyed.output(spark, root)) == want


def test_streamed_log_text_has_positions_and_forgets_closed_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = '@nix {"action":"start","id":1,"fields":["d"]}\nnoise\n@nix {"action":"result","id":1,"type":101,"fields":["hello"]}\n'
    (tmp_path / "in" / "a.log").write_text(text)
    root = fresh_path(spark, "stream")
    targets = spark.createDataFrame([("pkg/d", "d", "x")], "tree_path string, drv_path string, system string")

    def consume():
        log = rd.read_build_log(spark, str(tmp_path / "in"), streaming=True)
        keyed.drain(sl.attribute_stream(log, targets, root, linger_s=0, timers=True), 500)

    consume()
    got = keyed.output(spark, root).orderBy("seq").collect()
    assert [(r.tree_path, r.status, r.line) for r in got] == [("pkg/d", "started", None), ("pkg/d", "line", "hello")]
    state = keyed.state(spark, root, "bound")
    assert state.count() == 1
    # An id that has ended is forgotten; one of another run stays.
    with open(tmp_path / "in" / "a.log", "a") as f:
        f.write('@nix {"action":"stop","id":1}\n')
    (tmp_path / "in" / "b.log").write_text(text)
    consume()
    assert [r.key.run.rsplit("/")[-1] for r in keyed.state(spark, root, "bound").collect()] == ["b.log"]


def test_whole_tables_give_every_class_of_change(spark):
    from buildgraph.plans import registry

    registry.load()
    diff = registry.QUERIES["snapshot_diff"](spark, "/root/testdata/sf0.01")
    assert {r.change for r in diff.select("change").distinct().collect()} == {"added", "removed", "changed", "unchanged"}
    parent, current = t.snapshots(spark, "/root/testdata/sf0.01")
    n = t.table(spark, "/root/testdata/sf0.01", "lineitem").count()
    count = F.sum(F.split("drv_path", "-")[0].cast("int"))
    assert parent.agg(count).first()[0] + current.agg(count).first()[0] == n


def test_extraction_from_a_big_text(spark, big):
    table = spark.createDataFrame([("<<" + big + ">>",)], "text string")
    got = extract_between(table, "text", "<<", ">>", "map<string, string>")
    assert [tuple(r) for r in got.select("outcome", F.size("data")).collect()] == [("ok", BIG // 1000)]


def test_a_round_does_not_exchange_bucketed_edges(spark, rows, monkeypatch):
    from buildgraph.functions import skew

    pairs = [(f"n{i}", f"n{i // 2}") for i in range(1, 200)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    seeds = spark.createDataFrame([("n199",), ("n77",)], "id string")
    plain = rows(closure(edges, seeds))
    monkeypatch.setattr(skew, "BUCKETED_ROWS", 1)
    assert rows(closure(edges, seeds)) == plain
    stored = skew.StoredTable(edges, ["src"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = stored.join(seeds.select(F.col("id").alias("src")))
        assert joined.count() == 2
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("hot_rows", [5, 10**9])
def test_copies_of_edges_meet_in_the_buckets(spark, rows, monkeypatch, hot_rows):
    from buildgraph.functions import skew

    pairs = [(f"n{i % 100}", f"n{i % 100 // 2}") for i in range(300)]
    edges = spark.createDataFrame(pairs + [("n1", "n5")] * 40, "src string, dst string")
    seen = []
    monkeypatch.setattr(skew, "BUCKETED_ROWS", 1)
    monkeypatch.setattr(skew, "bucketed", lambda df, *a, **k: seen.append(k) or bucketed(df, *a, **k))
    stored = skew.StoredTable(edges, ["src"], ["dst"], hot_rows, distinct=True)
    assert rows(stored.rows.select("src", "dst")) == rows(edges.distinct())
    # With a hot key copies are left out before; then buckets are chosen by the distinct rows.
    assert seen == ([{"distinct": True}] if hot_rows == 10**9 else [{}])


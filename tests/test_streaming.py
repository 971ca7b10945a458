"""Every streaming operator, run in several micro-batches, equals its batch twin."""

import pytest
from pyspark.sql import functions as F

from buildgraph.functions.storage import fresh_path
from buildgraph.operators import attribution as a
from buildgraph.operators import state as s
from buildgraph.operators.graph import propagate_skips
from buildgraph.operators.throttle import throttle
from buildgraph.plans import tables as t
from buildgraph.sources import json_members, log_stream
from buildgraph.sources.readers import read_build_log
from buildgraph.streaming import keyed
from buildgraph.streaming import log as sl

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split(spark):
    """The events table as four files, in order."""
    path = fresh_path(spark, "events")
    events = t.table(spark, SF, "events")
    n = events.count()
    for i in range(4):
        part = events.filter((F.col("event_id") >= n * i // 4) & (F.col("event_id") < n * (i + 1) // 4))
        part.coalesce(1).write.mode("append").parquet(f"{path}/part={i}")
    return path, events


def stream(spark, split):
    path, events = split
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/part=*")


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def test_attribution_and_live_state(spark, split, rows):
    targets = t.log_targets(spark, SF)
    batch = a.attribute_log(t.log_of(split[1]), targets)
    root = fresh_path(spark, "stream")
    query = sl.attribute_stream(t.log_of(stream(spark, split)), targets, root)
    finish(query)
    landed = keyed.output(spark, root)
    assert query.lastProgress["batchId"] >= 3
    assert rows(landed.select(*batch.columns)) == rows(batch)
    # What a batch writes to its store follows the keys it touched.
    for p in query.recentProgress:
        written = p["stateOperators"][0]["numRowsUpdated"]
        assert written <= p["numInputRows"] < 2 * batch.count()

    second = fresh_path(spark, "stream")
    source = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 3).parquet(f"{root}/output")
    edges = t.tracked_edges(spark, SF)
    query = sl.live_state_stream(source, second, edges)
    finish(query)
    assert query.lastProgress["batchId"] >= 3
    want = s.last_events(batch).join(s.durations(batch), "tree_path", "left")
    names = ["tree_path", "state", "exit_code", "duration_latest_ms", "duration_total_ms"]
    got = sl.live_state(spark, second).select(names)
    assert rows(got) == rows(want.withColumn("duration_total_ms", F.coalesce("duration_total_ms", F.lit(0))).select(names))


LOG = "run string, id bigint, seq bigint, action string, type bigint, arg_text string, arg_int bigint"


def land(spark, path, n, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{path}/p{n}")
    return spark.readStream.schema(schema).parquet(f"{path}/p*")


def test_state_of_an_ended_id_goes_after_its_time(spark):
    path, root = fresh_path(spark, "in"), fresh_path(spark, "stream")
    targets = spark.createDataFrame([("/d/1", "t1", "x"), ("/d/2", "t2", "x")], "drv_path string, tree_path string, system string")
    first = [("r", 1, 1, "start", None, "/d/1", None), ("r", 2, 2, "start", None, "/d/2", None), ("r", None, 3, "start", None, "/d/9", None)]
    source = land(spark, path, 0, [*first, ("r", 1, 4, "result", 0, None, 0), ("r", 1, 5, "stop", None, None, None)], LOG)
    keyed.drain(sl.attribute_stream(source, targets, root, linger_s=0.5, timers=True), 1500)
    assert [r.key.id for r in keyed.state(spark, root, "bound").collect()] == [2]
    # The open id keeps its binding over batches; the ended one is unknown, so its results are dropped.
    source = land(spark, path, 1, [("r", 2, 6, "result", 0, None, 3), ("r", 1, 7, "result", 0, None, 0), ("r", 1, 8, "result", 101, "x", None)], LOG)
    finish(sl.attribute_stream(source, targets, root))
    got = sorted((r.seq, r.tree_path, r.status) for r in keyed.output(spark, root).collect())
    assert got == [(1, "t1", "started"), (2, "t2", "started"), (3, "/d/9", "started"), (4, "t1", "succeeded"), (6, "t2", "failed"), (8, "build", "line")]


EVENTS = "tree_path string, seq bigint, ts_us bigint, status string, exit_code bigint"


def test_skips_grow_from_new_failures_only(spark, monkeypatch):
    path, root = fresh_path(spark, "in"), fresh_path(spark, "stream")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("y", "x"), ("c", "y"), ("a", "d")], "src string, dst string")
    targets = spark.createDataFrame([(n, "/" + n) for n in "abcdxyz"], "tree_path string, drv_path string")

    def batch(n, *events):
        source = land(spark, path, n, [(p, i, i * 1000, st, c) for p, i, st, c in events], EVENTS)
        query = sl.live_state_stream(source, root, edges)
        finish(query)
        report = sl.live_report(spark, root, targets)
        want = propagate_skips(targets.join(sl.live_state(spark, root).select("tree_path", "state"), "tree_path", "left").withColumn("state", F.coalesce("state", F.lit("pending"))), edges)
        assert {r.tree_path: r.state for r in report.collect()} == {r.tree_path: r.state for r in want.collect()}
        return query.graph.rounds

    assert batch(0, ("z", 1, "started", None), ("x", 2, "started", None)) == 0
    assert batch(1, ("x", 3, "failed", 2)) == 1
    # No new failure: no edge is followed.
    assert batch(2, ("z", 4, "succeeded", 0), ("x", 5, "failed", 1)) == 0
    assert batch(3, ("b", 6, "failed", 1)) == 1
    # A failed target that recovers takes its dependents back.
    assert batch(4, ("x", 7, "started", None), ("x", 8, "succeeded", 0)) == 1
    assert batch(5, ("b", 9, "succeeded", 0)) == 0


@pytest.mark.parametrize("key", ["user_id", "event_type"])
def test_throttle(spark, split, rows, key):
    def shape(df):
        return df.select(F.col(key).cast("string").alias("k"), F.unix_micros(F.col("ts").cast("timestamp_ltz")).alias("ts_us"), F.col("event_id").alias("seq"))

    root = fresh_path(spark, "stream")
    keyed.drain(sl.throttle_stream(shape(stream(spark, split)), root, "k", 50_000, closing_s=0.5, timers=True), 500)
    out = keyed.output(spark, root)
    assert rows(sl.throttled(out, "k")) == rows(throttle(shape(split[1]), ["k"], 50_000))
    # Closing updates came out by themselves.
    assert out.where("closing").count() > 0
    with pytest.raises(ValueError):
        sl.throttle_stream(shape(stream(spark, split)), root, "k", 0)


def test_a_closing_update_that_was_overtaken_is_left_out(spark):
    path, root = fresh_path(spark, "in"), fresh_path(spark, "stream")
    kinds = "k string, ts_us bigint, seq bigint"
    source = land(spark, path, 0, [("a", 0, 0), ("a", 10, 1), ("b", 0, 2), (None, 5, 3), (None, 6, 4)], kinds)
    keyed.drain(sl.throttle_stream(source, root, "k", 1, closing_s=0, timers=True), 300)
    assert sorted((r.k or "", r.seq) for r in keyed.output(spark, root).where("closing").collect()) == [("", 4), ("a", 1)]
    source = land(spark, path, 1, [("a", 20, 5), ("a", 2_000_000, 6)], kinds)
    keyed.drain(sl.throttle_stream(source, root, "k", 1, closing_s=0, timers=True), 300)
    got = sorted((r.k or "", r.seq) for r in sl.throttled(keyed.output(spark, root), "k").collect())
    assert got == [("", 3), ("", 4), ("a", 0), ("a", 6), ("b", 2)]


def test_line_buffer(spark, split, rows):
    def lines(df):
        return t.log_of(df).filter("type = 101").select("id", "seq", F.col("arg_text").alias("line"))

    root = fresh_path(spark, "stream")
    query = sl.buffer_stream(lines(stream(spark, split)), root, "id", 3)
    finish(query)
    got = sl.buffered(spark, root, "id")
    assert rows(got) == rows(s.line_buffer(lines(split[1]), 3, key="id").select("id", "seq", "line"))
    assert got.groupBy("id").count().agg(F.max("count")).first()[0] <= 3


def test_log_source(spark, tmp_path):
    (tmp_path / "a.log").write_text('@nix {"action":"start","id":1,"fields":["d"]}\nnoise\n')
    (tmp_path / "b.log").write_text('@nix {"action":"msg","msg":"m"}\n@nix {"action":"msg","msg":"not yet com')
    root = fresh_path(spark, "stream")

    def run():
        log = read_build_log(spark, str(tmp_path), streaming=True)
        query = log.writeStream.format("parquet").option("path", root + "/o").option("checkpointLocation", root + "/c").trigger(availableNow=True).start()
        finish(query)
        return sorted((r.run.rsplit("/", 1)[1], r.seq, r.action, r.msg) for r in spark.read.parquet(root + "/o").collect())

    first = [("a.log", 0, "start", None), ("b.log", 0, "msg", "m")]
    assert run() == first
    # A growing file is read on where it was left; a line counts once it is complete.
    with open(tmp_path / "b.log", "a") as f:
        f.write('plete"}\n')
    (tmp_path / "c.log").write_text('@nix {"action":"msg","msg":"c"}\n')
    assert run() == [*first, ("b.log", 32, "msg", "not yet complete"), ("c.log", 0, "msg", "c")]


def test_lines_have_one_place_however_a_file_is_cut(tmp_path, monkeypatch):
    text = "a\n\nbb\r\nüü\nlong line that spans ranges\n\n"
    path = tmp_path / "f.log"
    path.write_bytes(text.encode() + b"open")
    want = []
    at = 0
    for line in text.encode().split(b"\n")[:-1]:
        want.append((line.removesuffix(b"\r").decode(), at))
        at += len(line) + 1
    for chunk in (1, 3, 1000):
        monkeypatch.setattr(log_stream, "CHUNK_BYTES", chunk, raising=False)
        monkeypatch.setattr(json_members, "CHUNK_BYTES", chunk)
        for split in (1, 2, 5, 1000):
            for complete in (False, True):
                reader = log_stream.LineReader({"path": str(tmp_path), "split": str(split), "complete": str(complete).lower()})
                end = reader.latestOffset()
                got = [x for p in reader.partitions(reader.initialOffset(), end) for x in log_stream.lines_of(p)]
                assert sorted(got, key=lambda x: x[1]) == want + ([("open", at)] if complete else [])
                middle = {"files": {str(path): want[3][1]}}
                rest = [x for p in reader.partitions(middle, end) for x in log_stream.lines_of(p)]
                assert sorted(rest, key=lambda x: x[1]) == want[3:] + ([("open", at)] if complete else [])
    assert log_stream.list_files(str(tmp_path / "*.log")) == [(str(path), len(text.encode()) + 4)]
    assert log_stream.list_files(str(tmp_path / "x*")) == []

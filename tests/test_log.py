import pytest
from pyspark.sql import functions as F

from buildgraph.operators import attribution as a
from buildgraph.operators import state as s
from buildgraph.sources import readers

LINES = [
    '@nix {"action":"start","id":1,"fields":["/d/a"],"type":105}',
    '@nix {"action":"result","id":1,"type":101,"fields":["hello"]}',
    "plain text",
    '@nix {"action":"msg","msg":"note"}',
    '@nix {"fields":[]}',
    '@nix {"action":"result","id":9,"type":101,"fields":["lost"]}',
    '@nix {"action":"result","id":9,"type":0,"fields":[1]}',
    '@nix {"action":"start","id":1,"fields":["/d/b"]}',
    '@nix {"action":"result","id":1,"type":0,"fields":[2]}',
    '@nix {"action":"result","id":1,"type":0,"fields":["0"]}',
    '@nix {"action":"result","id":1,"type":0,"fields":[0]}',
    '@nix {"action":"result","id":1,"type":105,"fields":[3]}',
    '@nix {"action":"start","id":2}',
    '@nix {"action":"result","id":2,"type":101,"fields":[5]}',
    '@nix {"action":"result","id":2,"fields":[5]}',
    '@nix {"action":"start","fields":["/d/a"]}',
    '@nix {"action":"other","id":1}',
]


@pytest.fixture(scope="module")
def log(spark):
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "seq bigint, value string")
    return readers.parse_log_lines(lines).withColumn("run", F.lit("r"))


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame(
        [("tree/a", "/d/a", None), ("tree/z", "/d/a", "x"), ("tree/c", "/d/c", "x")],
        "tree_path string, drv_path string, system string",
    )


EXPECTED = [
    (0, "tree/a", "/d/a", "", "started", None, None),
    (1, "tree/a", "/d/a", None, "line", None, "hello"),
    (5, "build", None, None, "line", None, "lost"),
    (7, "/d/b", "/d/b", "unknown", "started", None, None),
    (8, "/d/b", "/d/b", "unknown", "failed", 2, None),
    (9, "/d/b", "/d/b", "unknown", "failed", None, None),
    (10, "/d/b", "/d/b", "unknown", "succeeded", 0, None),
    (11, "/d/b", "/d/b", "unknown", "succeeded", 3, None),
    (12, "unknown", "unknown", "unknown", "started", None, None),
    (13, "build", "unknown", None, "line", None, ""),
    (15, "tree/a", "/d/a", "", "started", None, None),
]
COLS = ("seq", "tree_path", "drv_path", "system", "status", "exit_code", "line")


@pytest.mark.parametrize("block_rows,hot_rows", [(1 << 20, 100_000), (2, 1)])
def test_attribution_cases(log, targets, block_rows, hot_rows):
    got = a.attribute_log(log, targets, block_rows=block_rows, hot_rows=hot_rows)
    assert sorted(tuple(r) for r in got.select(*COLS).collect()) == EXPECTED


def test_strict_counts_type_zero_only(log, targets):
    got = a.attribute_log(log, targets, strict=True)
    assert sorted(r["seq"] for r in got.collect()) == [r[0] for r in EXPECTED if r[0] != 11]


def test_lines_can_be_left_out(log, targets):
    got = a.attribute_log(log, targets, lines=False)
    assert sorted(r["seq"] for r in got.collect()) == [r[0] for r in EXPECTED if r[4] != "line"]


def test_messages(log, rows):
    assert rows(a.messages(log)) == [("r", 3, "note")]


def test_malformed_line_modes(spark):
    lines = spark.createDataFrame(
        [('@nix {"action":"msg"}',), ('@nix {"action":',), ('@nix {"action":"msg"}}',)], "value string"
    )
    assert readers.parse_log_lines(lines, "quarantine").count() == 1
    assert readers.malformed_log_lines(lines).count() == 2
    with pytest.raises(Exception, match="malformed log line"):
        readers.parse_log_lines(lines).collect()
    with pytest.raises(ValueError):
        readers.parse_log_lines(lines, "maybe")


def test_read_build_log_orders_lines(spark, tmp_path, targets):
    (tmp_path / "one.log").write_text("\n".join(LINES))
    log = readers.read_build_log(spark, str(tmp_path))
    order = [r["seq"] for r in log.orderBy("seq").collect()]
    assert len(order) == len(set(order)) == 15
    statuses = [r["status"] for r in a.attribute_log(log, targets).orderBy("seq").collect()]
    assert statuses == [e[4] for e in EXPECTED]


EV = "tree_path string, seq bigint, status string, exit_code bigint, ts_us bigint"


def events(spark, *rows):
    return spark.createDataFrame(rows, EV)


def test_final_state(spark, rows):
    ev = events(
        spark,
        ("a", 1, "started", None, 0), ("a", 2, "failed", 3, 0), ("a", 3, "started", None, 0),
        ("b", 4, "substitution", 0, 0), ("c", 5, "skipped", None, 0),
    )
    targets = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "tree_path string")
    assert rows(s.final_state(ev, targets)) == [
        ("a", "building", 3), ("b", "succeeded", None), ("c", "skipped", None), ("d", "pending", None),
    ]


@pytest.mark.parametrize("block_rows", [1 << 20, 1])
def test_durations_by_both_definitions(spark, rows, block_rows):
    ms = 1000
    ev = events(
        spark,
        ("a", 1, "started", None, 0), ("a", 2, "started", None, 10 * ms), ("a", 3, "failed", 1, 30 * ms),
        ("a", 4, "started", None, 50 * ms), ("a", 5, "succeeded", 0, 55 * ms), ("a", 6, "started", None, 60 * ms),
        ("b", 7, "succeeded", 0, 70 * ms), ("b", 8, "started", None, 80 * ms), ("b", 9, "failed", 1, 90 * ms),
        ("b", 10, "failed", 1, 95 * ms), ("c", 11, "started", None, 1), ("d", 12, "failed", 1, 5),
    )
    assert rows(s.durations(ev, block_rows=block_rows)) == [("a", 5, 35), ("b", 15, 10), ("d", None, 0)]


def test_log_tail_limits(spark):
    lines = spark.createDataFrame([("a", i, f"l{i}") for i in range(250)], "tree_path string, seq bigint, line string")
    row = s.log_tail(lines).first()
    assert row["log"].split("\n") == [f"l{i}" for i in range(50, 250)]
    assert row["log_tail"].split("\n") == [f"l{i}" for i in range(230, 250)]
    assert s.log_tail(lines.limit(0)).count() == 0


RES = "tree_path string, status string, exit_code bigint, duration_ms bigint, log string"
ATT = "tree_path string, attempt int, ok boolean, duration_ms bigint"


def test_retry_fold(spark):
    long = "\n".join(["HTTP 503"] + [f"x{i}" for i in range(30)]) + "\n"
    results = spark.createDataFrame(
        [
            ("won", "failed", 1, 100, "timeout"), ("lost", "failed", 1, 100, long),
            ("plain", "failed", 2, 100, "error\n"), ("mute", "failed", 1, 100, None),
            ("empty", "failed", 1, 100, ""), ("fine", "succeeded", 0, 100, "timeout"),
            ("upper", "failed", 1, None, "TIMEOUT"), ("late", "failed", 1, None, "Broken pipe"),
        ],
        RES,
    )
    attempts = spark.createDataFrame(
        [("won", 1, False, 5), ("won", 2, True, 7), ("won", 3, True, 9), ("lost", 1, False, 5), ("late", 4, True, 1)], ATT
    )
    got = {r["tree_path"]: r for r in s.apply_retries(results, attempts, 3).collect()}
    won = got["won"]
    assert (won.status, won.exit_code, won.duration_ms, won.retry_count, won.log_tail, won.backoff_s) == (
        "succeeded", 0, 107, 2, None, 15)
    lost = got["lost"]
    assert (lost.status, lost.exit_code, lost.retry_count, lost.backoff_s) == ("failed", 1, 3, 30)
    assert lost.log_tail.split("\n") == [f"x{i}" for i in range(10, 30)]
    assert (got["plain"].log_tail, got["plain"].retry_count) == ("error", None)
    assert got["mute"].log_tail is None and got["empty"].log_tail is None
    assert (got["fine"].status, got["fine"].retry_count) == ("succeeded", None)
    assert got["upper"].retry_count is None and got["late"].retry_count == 3
    none = s.apply_retries(results, attempts, 0).filter("retry_count IS NOT NULL OR log_tail IS NOT NULL")
    assert none.count() == 0


def test_resolve_pending(spark, rows):
    results = spark.createDataFrame(
        [("a", "da", "pending"), ("b", "db", "pending"), ("c", "dc", "pending"), ("d", "dd", "failed")],
        "tree_path string, drv_path string, status string",
    )
    outputs = spark.createDataFrame([("da", "p1"), ("da", "p2"), ("db", "p3")], "drv_path string, path string")
    store = spark.createDataFrame([("p1",), ("p3",)], "path string")
    got = s.resolve_pending(results, outputs, store, False)
    assert rows(got, "tree_path", "status") == [("a", "skipped"), ("b", "succeeded"), ("c", "succeeded"), ("d", "failed")]
    assert rows(s.resolve_pending(results, outputs, store, True), "status")[-1] == ("succeeded",)


def test_counts_and_all(spark, rows):
    state = spark.createDataFrame([("failed",), ("skipped",), ("succeeded",)], "state string")
    assert rows(s.state_counts(state)) == [(0, 0, 1, 1, 1, 2)]
    assert rows(s.all_succeeded(state, col="state")) == [(False,)]
    assert rows(s.all_succeeded(state.limit(0), col="state")) == [(True,)]

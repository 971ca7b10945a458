import pytest
from pyspark.sql import functions as F

from buildgraph.operators import chunking as c
from buildgraph.operators import lookup as lk
from buildgraph.operators import pins as p

PINS = "npm_name string, pinned_version string, dir_name string"


@pytest.fixture(scope="module")
def pins(spark):
    return spark.createDataFrame([("@s/a", "1.0.0", "a"), ("b", "2.0.0", "b"), ("a", "3.0.0", "aa")], PINS)


def registry(spark, *rows):
    return spark.createDataFrame(rows, "npm_name string, latest string, error string")


def installed(spark, *rows):
    return spark.createDataFrame(rows, "npm_name string, version string")


def test_latest_stale_current_and_failure(spark, pins, rows):
    reg = registry(spark, ("@s/a", "1.0.0", None), ("b", "2.3.0", None), ("a", None, "boom"))
    found = p.check_pins(pins, reg)
    assert rows(found) == [("a", "3.0.0", None, 2, "boom"), ("b", "2.0.0", "2.3.0", 1, None)]
    assert rows(p.exit_severity(found)) == [(2,)]
    assert rows(p.exit_severity(found.filter("severity = 1"))) == [(1,)]
    assert rows(p.exit_severity(found.limit(0))) == [(0,)]


def test_installed_missing_is_stale(spark, pins, rows):
    found = p.check_pins(pins, installed(spark, ("@s/a", "1.0.0"), ("a", "3.0.0")), "installed")
    assert rows(found) == [("b", "2.0.0", "<not installed>", 1, None)]
    with pytest.raises(ValueError):
        p.check_pins(pins, found, "other")


def test_status(spark, pins, rows):
    got = p.version_status(pins, registry(spark, ("b", None, "down")), installed(spark, ("b", "9")))
    assert rows(got) == [
        ("@s/a", "1.0.0", "ERR (no registry document)", "-"), ("a", "3.0.0", "ERR (no registry document)", "-"),
        ("b", "2.0.0", "ERR (down)", "9"),
    ]


def test_collisions(spark, pins, rows):
    new = spark.createDataFrame([("b", "b"), ("n", "a"), ("m", "m")], "npm_name string, dir_name string")
    assert rows(p.collisions(new, pins, pins.select("dir_name"))) == [
        ("b", "b", "b is already pinned (2.0.0)"), ("n", "a", "a already exists"),
    ]


def test_selection(spark, pins):
    req = spark.createDataFrame([(0, "b"), (1, "a"), (2, "zz"), (3, "aa")], "pos int, name string")
    got = [(r["requested"], r["npm_name"], r["error"]) for r in p.select_targets(pins, req).collect()]
    assert got == [("b", "b", None), ("a", "a", None), ("zz", None, "unknown package 'zz'"), ("aa", "a", None)]
    assert p.select_targets(pins, everything=True).count() == 3
    with pytest.raises(ValueError):
        p.select_targets(pins)


@pytest.mark.parametrize("hot_rows", [1, 100_000])
def test_backfill(spark, rows, hot_rows):
    url = "https://registry.npmjs.org/x"
    lock = spark.createDataFrame(
        [("f", "a", "1", url, None, False), ("f", "b", "1", url, "own", True), ("f", "c", "1", "git://x", None, False),
         ("f", "", None, None, None, False), ("f", "d", "1", url, None, False), ("g", "e", None, url, None, False), ("g", "a", "1", url, "", True)],
        "file string, name string, version string, resolved string, integrity string, has_integrity boolean",
    )
    reg = spark.createDataFrame([("a", "1", "sha512-A"), ("b", "1", "no"), ("d", "1", ""), ("c", "1", "no")], "name string, version string, integrity string")
    got = p.backfill_integrity(lock, reg, hot_rows=hot_rows)
    assert rows(got, "file", "name", "integrity", "outcome") == sorted([
        ("f", "", None, "untouched"), ("f", "a", "sha512-A", "fixed"), ("f", "b", "own", "untouched"),
        ("f", "c", None, "untouched"), ("f", "d", None, "missing"), ("g", "a", "", "untouched"), ("g", "e", None, "untouched"),
    ], key=lambda t: tuple(map(repr, t)))
    assert rows(p.fix_counts(got)) == [("f", 1, 1), ("g", 0, 0)]


def test_merge(spark, rows):
    a = spark.createDataFrame([("x", "1"), ("y", "1")], "k string, v string")
    b = spark.createDataFrame([("y", None), ("z", "2")], "k string, v string")
    assert rows(lk.merge_right(a, b, "k")) == [("x", "1"), ("y", None), ("z", "2")]


ENTRY = "commit string, validator string, payload string"


def test_lookup_chain(spark, rows):
    req = spark.createDataFrame([(k, None if k == "null" else "v") for k in ("hit", "stale", "bad", "miss", "null", "again", "gone")], "commit string, validator string")
    local = spark.createDataFrame([("hit", "v", "{}"), ("stale", "w", "{}"), ("bad", "v", "{"), ("null", None, "{}"), ("gone", "v", None)], ENTRY)
    remote = spark.createDataFrame([("stale", "v", '{"r":1}'), ("bad", "w", "{}")], ENTRY)
    again = spark.createDataFrame([("again", '{"e":1}'), ("hit", '{"e":1}')], "commit string, payload string")
    got = lk.lookup_chain(req, [("local", local), ("remote", remote)], again, hot_rows=1)
    assert rows(got, "commit", "local_outcome", "remote_outcome", "origin", "payload") == [
        ("again", "miss", "miss", "recomputed", '{"e":1}'), ("bad", "corrupt", "stale", "empty", "{}"),
        ("gone", "miss", "miss", "empty", "{}"), ("hit", "hit", "miss", "local", "{}"),
        ("miss", "miss", "miss", "empty", "{}"), ("null", "miss", "miss", "empty", "{}"),
        ("stale", "stale", "hit", "remote", '{"r":1}'),
    ]
    assert lk.storable(local).count() == 4


def test_retention(spark, rows):
    commits = spark.createDataFrame(
        [("r", f"c{i}", i, i, i == 9, {8: 0, 3: 1}.get(i)) for i in range(10)],
        "repo string, commit string, commit_time bigint, position bigint, is_head boolean, parent_pos int",
    )
    assert [t[0] for t in rows(c.keep_set(commits, 3), "commit")] == ["c7", "c8", "c9"]
    assert [t[0] for t in rows(c.keep_set(commits, 2, "parents"), "commit")] == ["c8", "c9"]
    assert lk.prune(commits, c.keep_set(commits, 3)).count() == 7
    with pytest.raises(ValueError):
        c.keep_set(commits, 0)


def test_newest_breaks_ties_by_position(spark, rows):
    cand = spark.createDataFrame([("a", 5, 0), ("b", 5, 1), ("c", None, 2)], "sha string, commit_time bigint, pos int")
    assert rows(c.newest(cand)) == [("b", True)]
    assert rows(c.newest(cand.filter("sha = 'c'"))) == [("c", False)]


def test_entry_states(spark, rows):
    head = spark.createDataFrame([("r", "a", "x"), ("r", "b", "x"), ("r", "c", "x"), ("r", "d", "x")], "repo string, commit string, artifact string")
    have = spark.createDataFrame([("r", "a", "x"), ("r", "b", "y"), ("r", "c", None)], "repo string, commit string, artifact string")
    assert rows(lk.entry_state(have, head), "commit", "state", "create") == [
        ("a", "current", False), ("b", "stale", True), ("c", "stale", True), ("d", "empty", True),
    ]


def reconcile(packages, declared, remove):
    """What the rule says, on one small list of (value, is_object)."""
    kept = [e for e in packages if e[1] or not (e[0] in remove or e[0].startswith("/nix/store/"))]
    return kept + [(d, False) for d in dict.fromkeys(declared)]


@pytest.mark.parametrize("declared", [["/nix/store/x", "npm:n", "/nix/store/x"], [], ["npm:n"]])
def test_reconcile(spark, declared):
    docs = {
        "same": [("o", True), ("npm:k", False), ("/nix/store/x", False), ("npm:n", False)],
        "stale": [("/nix/store/x-old", False), ("npm:old", False)],
        "order": [("npm:n", False), ("/nix/store/x", False)],
        "empty": [],
        "twice": [("/nix/store/x", False), ("/nix/store/x", False)],
        "done": [("npm:k", False), ("npm:old", True)],
    }
    remove = ["npm:old", "npm:n"]
    entries = spark.createDataFrame(
        [(d, i, o, v) for d, es in docs.items() for i, (v, o) in enumerate(es)] or [],
        "doc_id string, pos int, is_object boolean, value string",
    )
    df = spark.createDataFrame([(d, ["s"]) for d in docs], "doc_id string, skills array<string>")
    got = {d: [] for d in docs}
    for r in lk.reconcile_lists(df, entries, declared, remove).orderBy("doc_id", "part", "pos").collect():
        got[r["doc_id"]].append((r["value"], r["is_object"]))
    want = {d: reconcile(es, declared, remove) for d, es in docs.items()}
    assert got == want
    flags = {r["doc_id"]: r["unchanged"] for r in lk.reconciled_documents(df, entries, declared, remove).collect()}
    assert flags == {d: want[d] == docs[d] for d in docs}
    new = lk.reconciled_documents(df, entries, declared, remove, ["t"]).first()
    assert new["skills"] == ["t"] and new["unchanged"] is False


def test_routes(spark):
    def table(name, *values):
        return spark.createDataFrame([(v,) for v in values], name)

    urls = ["https://ok.ee/", "https://ok.ee", "https://OK.ee/resume//", "https://ok.ee/pgp/", "https://ok.ee/none", "https://bad.ee/resume", "https://ok.ee/resume?x=1#y", "no url"]
    red = spark.createDataFrame([("", "https://home"), ("/resume", "https://cv")], "path string, target string")
    got = lk.route(table("url string", *urls), table("host string", "ok.ee"), table("path string", "/pgp"), red)
    assert {r["url"]: (r["status"], r["location"]) for r in got.collect()} == dict(zip(urls, [
        (302, "https://home"), (302, "https://home"), (302, "https://cv"), (200, None), (404, None), (403, None), (302, "https://cv"), (403, None)]))


def test_ordered_distinct(spark, rows):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, v string")
    assert rows(c.ordered_distinct(df, "k", ["o"])) == [("a", 1, "y"), ("b", 3, None)]

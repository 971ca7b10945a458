import pytest
from pyspark.sql import functions as F

from buildgraph.functions import text as x
from buildgraph.operators import extract as ex
from buildgraph.operators import filters as f
from buildgraph.operators import owners as o
from buildgraph.operators import reports as r
from buildgraph.operators import words as w

OWN = "array<struct<discord: string, github: string>>"


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def tree(spark, *paths):
    return spark.createDataFrame([(p.split("/"),) for p in paths], "parts array<string>")


def test_visible_targets(spark):
    files = tree(
        spark,
        "default.nix", "shell.nix", "x.nix",
        "a/default.nix", "a/shell.nix", "a/other.nix", "a/b/one.nix", "a/b/two.nix", "a/b/README.md",
        "skip/.skip-tree", "skip/default.nix", "skip/deep/default.nix",
        "sub/.skip-subtree", "sub/default.nix", "sub/shell.nix", "sub/deep/default.nix", "sub/deep/er/default.nix",
        "bare/.skip-subtree", "bare/one.nix",
        ".hidden/default.nix", "a/.git/default.nix", "a/b/.secret.nix",
    )
    got = sorted("/".join(r["parts"]) for r in f.visible_targets(files).collect())
    assert got == ["a", "a/b/one", "a/b/two", "a/shell", "shell", "sub"]


def test_root_skip_tree_is_an_error(spark):
    with pytest.raises(Exception, match="skip-tree"):
        f.visible_targets(tree(spark, ".skip-tree", "a/default.nix")).collect()


def test_root_subtree_marker_stops_everything(spark):
    assert f.visible_targets(tree(spark, ".skip-subtree", "x.nix", "a/default.nix")).count() == 0


def test_crate_source_rules(spark):
    paths = [
        ("src/main.rs", "regular"), ("target", "directory"), ("target", "regular"), ("result-1", "symlink"),
        ("result-1", "regular"), ("a/Cargo.nix", "regular"), ("x~", "regular"), (".swp", "regular"),
        (".a.swp", "regular"), ("b.swp", "regular"), ("y.bak", "regular"), (".gitignore", "regular"), (".git", "directory"),
    ]
    df = spark.createDataFrame(paths, "path string, type string")
    kept = sorted(tuple(q) for q in f.filter_paths(df, **f.CRATE_SOURCES).collect())
    assert kept == [("b.swp", "regular"), ("result-1", "regular"), ("src/main.rs", "regular"), ("target", "regular")]
    nix = f.filter_paths(spark.createDataFrame([("a.nix", "regular"), ("d", "directory"), ("target", "directory"), ("b.py", "regular")], df.schema), **f.NIX_SOURCES)
    assert sorted(q["path"] for q in nix.collect()) == ["a.nix", "d"]
    tf = f.filter_paths(spark.createDataFrame([("a.tf", "regular"), (".x.tf", "regular"), ("b", "regular")], df.schema), **f.TERRAFORM_SOURCES)
    assert [q["path"] for q in tf.collect()] == ["a.tf"]


def test_unowned(spark):
    df = spark.createDataFrame(
        [("none", []), ("null", None), ("blank", [("", None)]), ("mixed", [(None, ""), ("d", None)]), ("ok", [(None, "g")])],
        f"tree_path string, owners {OWN}",
    )
    assert sorted(q["tree_path"] for q in f.unowned(df).collect()) == ["blank", "none", "null"]


def test_transient_patterns(spark):
    assert len(f.TRANSIENT_PATTERNS) == 18
    df = spark.createDataFrame([("x timeout y",), ("TIMEOUT",), ("HTTP 500",), ("HTTP 502",), (None,)], "log string")
    assert [q["transient"] for q in f.classify_transient(df).collect()] == [True, False, False, True, False]


def test_rule_violations(spark, rows):
    df = spark.createDataFrame([(1, "build", "go?"), (2, "odd", None)], "id int, phase string, prompt string")
    got = f.check_rules(df, [f.known_phase(["build"]), f.no_prompt_in_build()], ["id"])
    assert rows(got, "id", "rule") == [(1, "no_prompt_in_build"), (2, "known_phase")]


def test_restricted(spark):
    refs = spark.createDataFrame(
        [(["x", "a"], ["top", "b"]), (["top", "a"], ["top", "b"]), (["x", "c"], ["top", "b"]), (["x", "a"], ["y"])],
        "from_parts array<string>, to_parts array<string>",
    )
    listed = spark.createDataFrame([(["x", "c"],)], "parts array<string>")
    assert [q["from_parts"] for q in f.audit_restricted(refs, "top", listed).collect()] == [["x", "a"]]


def test_extract_between_outcomes(spark, rows):
    html = [
        ("captcha é",), ("data = {\"k\": 1}",), ("data = {\"k\": 1}</s> data = no</s>",),
        ("data = {\"k\": 1}}</s>",), ("</s> data = {\"k\": 2}</s>",), ("data = </s>",),
    ]
    df = spark.createDataFrame(html, "html string")
    got = ex.extract_between(df, "html", "data = ", "</s>", "k int")
    assert [(q["outcome"], q["n_bytes"], q["data"] and q["data"]["k"]) for q in got.collect()] == [
        ("missing_open", 10, None), ("unterminated", None, None), ("ok", None, 1),
        ("bad_json", None, None), ("ok", None, 2), ("bad_json", None, None),
    ]


DEF = 'x\nmake {\n  pname = "p";\n  srcHash = "sha256-A=";\n}\n'


def test_extract_exactly_one(spark):
    texts = [
        DEF, DEF.replace("  pname", '  npmName = "@s/p";\n  pname'), DEF.replace("  srcHash", "  other"),
        "nothing", '  srcHash = "sha256-OLD=";\n' + DEF, DEF + '  srcHash = "sha256-B=";\n',
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = ex.extract_exactly_one(df, "text", "make", ["pname", "srcHash"], {"npmName": "pname"}).collect()
    assert [q["outcome"] for q in got] == ["ok", "ok", "no srcHash", "no_anchor", "ok", "srcHash matches 2 times"]
    assert [q["npmName"] for q in got[:2]] == ["p", "@s/p"]
    assert got[4]["srcHash"] == "sha256-A="


def test_got_hash(spark):
    df = spark.createDataFrame([("  specified: sha256-A=\n     got:    sha256-b/+c=\n",), ("fine",)], "text string")
    assert [q["got_hash"] for q in ex.extract_got_hash(df).collect()] == ["sha256-b/+c=", None]


@pytest.mark.parametrize("text,n,want", [
    ("a\nb\nc\n", 2, "b\nc"), ("a\nb\n\n", 2, "b\n"), ("", 3, ""), ("a", 3, "a"), ("a\r\nb\r\n", 5, "a\nb"),
])
def test_last_lines(spark, text, n, want):
    assert one(spark, x.last_lines(F.lit(text), n)) == want


@pytest.mark.parametrize("text,want", [
    ('{"a":1}', True), ('{"a":1}}', False), ("[1],[2]", False), ("1],[2", False), ('1},{"v":2', False), ('1,"x":2', False), ("", False), ("3", True),
])
def test_valid_json(spark, text, want):
    assert one(spark, x.valid_json(F.lit(text))) is want


def test_scalars(spark):
    lit = F.lit
    assert one(spark, x.encode_name(lit("@scope/some-pkg"))) == "%40scope%2Fsome-pkg"
    assert one(spark, x.encode_name(lit("a b*~"))) == "a%20b%2A~"
    assert one(spark, x.tarball_url(lit("@p/ext"), lit("0.27.11"))) == "https://registry.npmjs.org/@p/ext/-/ext-0.27.11.tgz"
    assert one(spark, x.decode_id(lit("MTIz"))) == "123"
    for bad in ("!!", "", "YWJj", "/////w=="):
        assert one(spark, x.decode_id(lit(bad))) is None
    assert one(spark, x.label(F.array(lit("a"), lit("b")), lit("s"))) == "a/b:s"
    assert one(spark, x.registry_crate_url(lit("https://r/{prefix}/{crate}/{version}"), lit("ab"), lit("1"), lit("s"))) == "https://r/2/ab/1"
    assert one(spark, x.registry_crate_url(lit("https://r"), lit("ab"), lit("1"), lit("s"))) == "https://r/ab/1/download"
    assert str(one(spark, x.civil_date(lit("2024-01-01 05:00:00").cast("timestamp")))) == "2023-12-31"
    assert one(spark, x.duration_text(lit(1250))) in ("1.2s", "1.3s")


def test_owner_roll_up(spark, rows):
    data = [
        ("a", "failed", 1, [("MTIz", "g")]), ("b", "failed", None, []), ("c", "failed", 2, [(None, "g"), (None, None)]),
        ("d", "succeeded", 0, [("MTIz", None)]), ("e", "failed", 3, [("", "h")]),
    ]
    res = spark.createDataFrame([(*t[:3], t[3], "sys" + t[0]) for t in data], f"tree_path string, status string, exit_code bigint, owners {OWN}, system string")
    every = "sysa, sysb, sysc, sysd, syse"
    assert rows(o.failures_by_owner(res)) == [
        ("", None, 1, every), ("MTIz", "123", 1, every), ("g", None, 1, every), ("unknown", None, 2, every),
    ]
    assert ("h", None, 1, every) in rows(o.failures_by_owner(res, empty_as_null=True))
    assert rows(o.owner_failures(res, hot_rows=1), "owner", "tree_path", "n_failed", "exit_text") == sorted([
        ("", "e", 1, "(exit 3)"), ("MTIz", "a", 1, "(exit 1)"), ("g", "c", 1, "(exit 2)"),
        ("unknown", "b", 2, ""), ("unknown", "c", 2, "(exit 2)")], key=lambda t: tuple(map(repr, t)))
    assert o.success_summary(res).count() == 0
    assert rows(o.success_summary(res.filter("status <> 'failed'"))) == [(1,)]


def test_reports(spark):
    state = spark.createDataFrame(
        [("b", "failed", "shell", 1200, None, [(None, "g"), ("d", None), (None, None)], 2, "tail", "x"),
         ("a", "skipped", None, 0, None, [], None, "no", "x"), ("c", "building", "odd", 0, 500, None, None, None, "x")],
        f"tree_path string, state string, dev_attr_type string, duration_ms bigint, elapsed_ms bigint, owners {OWN}, exit_code bigint, log_tail string, system string",
    )
    got = [tuple(q) for q in r.status_report(state).collect()]
    assert got == [
        ("a", ":no_entry_sign:", ":package:", 0, "—", "—"),
        ("b", ":x:", ":shell:", 1200, "1.2s", "g, d, ?"),
        ("c", ":hammer:", ":package:", 0, "0.5s", "—"),
    ]
    bad = [tuple(q) for q in r.failure_report(state).collect()]
    assert bad == [
        ("failed", "b", ":shell:", "exit code 2", "@g, @d, @?", "tail"),
        ("skipped", "a", ":package:", "skipped (dependency failure)", "none", None),
    ]
    head = r.report_header(state).first()["headline"]
    assert head == "### Build: x — 0 succeeded, 2 failed (1 skipped: dependency failure) | 1 building"


def test_steps_by_phase(spark):
    steps = spark.createDataFrame(
        [("g", "build", True, 0, 0), ("b", "build", False, 2, 0), ("a", "build", False, 1, 0), ("r", "release", False, 1, 1), ("t", "test", False, 1, 2)],
        "key string, phase string, is_global boolean, target_pos int, step_pos int",
    )
    got = r.steps_by_phase(steps, ["build", "release"], ["release", "test", "build"])
    assert sorted(tuple(q) for q in got.collect()) == [
        ("build", 1, 1, "a"), ("build", 1, 2, "b"), ("build", 1, 3, "g"), ("release", 2, 1, "r"),
    ]


def test_words(spark, rows):
    df = spark.createDataFrame([("éa",), ("éab",), ("x",), ("éa",)], "word string")
    assert rows(w.pair_counts(df)) == [("é", "a", 3)]
    assert rows(w.length_counts(df)) == [("é", 2, 2), ("é", 3, 1)]
    assert rows(w.short_words(df)) == [("x",)]
    grid = spark.createDataFrame([("seat",), ("seat",), ("tan",), ("rant",), ("seatz",)], "word string")
    assert rows(w.grid_words(grid, "e", "ahnrst")) == [("seat",)]
    with pytest.raises(ValueError):
        w.grid_words(grid, "e", "abc")

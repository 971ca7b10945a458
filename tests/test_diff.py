from buildgraph.operators import diff as d

S = "tree_path string, drv_path string, system string"


def snap(spark, *rows):
    return spark.createDataFrame(rows, S)


def parts(spark):
    parent = snap(spark, ("a", "1", "x"), ("b", "1", "x"), ("c", "1", None))
    current = snap(spark, ("b", "1", "y"), ("c", "2", None), ("d", "1", "x"))
    return parent, current


def test_four_classes(spark, rows):
    diff = d.diff_snapshots(*parts(spark))
    assert rows(diff, "tree_path", "change") == [
        ("a", "removed"), ("b", "unchanged"), ("c", "changed"), ("d", "added"),
    ]


def test_other_columns_do_not_count_and_come_from_current(spark, rows):
    diff = d.diff_snapshots(*parts(spark))
    assert rows(diff.filter("tree_path = 'b'"), "change", "system") == [("unchanged", "y")]
    assert rows(diff.filter("tree_path = 'a'"), "system", "drv_path") == [("x", "1")]


def test_classes_partition_the_key_union(spark):
    parent, current = parts(spark)
    diff = d.diff_snapshots(parent, current)
    keys = parent.select("tree_path").union(current.select("tree_path")).distinct()
    assert diff.count() == keys.count() == diff.select("tree_path").distinct().count()


def test_changed_only_equals_to_build(spark, rows):
    parent, current = parts(spark)
    diff = d.diff_snapshots(parent, current)
    assert rows(d.changed_targets(parent, current), "tree_path") == rows(d.to_build(diff), "tree_path")
    assert rows(d.removed(diff), "tree_path") == [("a",)]


def test_null_current_columns_do_not_fall_back(spark, rows):
    diff = d.diff_snapshots(snap(spark, ("a", "1", "x")), snap(spark, ("a", "2", None)))
    assert rows(diff, "system", "parent_drv_path") == [(None, "1")]


def test_by_system_groups_of_two_and_one(spark, rows):
    df = snap(spark, ("a", "1", "x86"), ("b", "1", "x86"), ("c", "1", None))
    assert rows(d.by_system(df)) == [("", 1), ("x86", 2)]


def test_empty_plan_has_no_final_step(spark):
    assert d.system_plan(snap(spark)).count() == 0


def test_plan_rows(spark, rows):
    df = snap(spark, ("a", "1", "x86_64-linux"), ("b", "1", "aarch64-darwin"), ("c", "1", "odd.one"))
    plan = d.system_plan(df)
    assert rows(plan, "key", "arch", "os", "skip") == [
        ("build-aarch64-darwin", "aarch64", "darwin", d.DARWIN_SKIP),
        ("build-odd-one", "unknown", "odd.one", None),
        ("build-x86_64-linux", "x86_64", "linux", None),
        ("ci-post-build", None, None, None),
    ]
    final = plan.filter("key = 'ci-post-build'").first()
    assert final["depends_on"] == ["build-aarch64-darwin", "build-odd-one", "build-x86_64-linux"]


def test_scopes(spark, rows):
    df = snap(spark, ("a", "1", "x"), ("b", "1", None))
    assert d.scope_system(df, "").count() == 2
    assert rows(d.scope_system(df, "x"), "tree_path") == [("a",)]
    assert d.scope_platform(df, "x").count() == 2
    assert rows(d.scope_platform(df, "y"), "tree_path") == [("b",)]


def test_summary_totals(spark, rows):
    summary = d.diff_summary(d.diff_snapshots(*parts(spark)))
    assert rows(summary) == [
        ("added", None, 1), ("changed", None, 1), ("removed", None, 1),
        ("to_build", "", 1), ("to_build", "x", 1), ("to_build", None, 2), ("unchanged", None, 1),
    ]

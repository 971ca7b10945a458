"""Plans of scale-sensitive operators, and the driver contract."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
BATCH = [
    "snapshot_diff", "diff_summary", "changed_targets", "visible_targets", "attribute_log", "final_state", "durations",
    "log_tail", "apply_retries", "backfill_integrity", "lookup_chain", "failures_by_owner", "owner_failures", "chunk",
    "keep_set", "first_match", "route", "reconcile_lists", "pair_counts", "check_rules",
]


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_products_python_or_global_windows(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    assert not re.search(r"BroadcastNestedLoopJoin", text)
    assert not re.search(r"PythonUDF|MapInPandas|FlatMapGroups|BatchEvalPython|ArrowEvalPython", text)
    for window in re.findall(r"Window\n(?:.*\n)*?Arguments: (.*)", text):
        assert not re.search(r"\], \[\], \[", window) or name == "chunk"


def test_scans_are_pruned_and_filtered(spark):
    text = plan(entry.queries()["snapshot_diff"](spark, SF))
    lineitem = re.findall(r"ReadSchema: struct<l_\S*", text)
    assert lineitem and all("l_extendedprice" not in s for s in lineitem)
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual" in text


def test_log_tail_is_pruned_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["log_tail"](spark, SF))


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["measure"] for r in rows} >= {"added", "changed", "unchanged", "removed", "to_build"}


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 80


def test_dropped_folders_are_not_broadcast(spark):
    text = plan(entry.queries()["visible_targets"](spark, SF))
    assert "BroadcastHashJoin LeftAnti" not in text and "SortMergeJoin LeftAnti" in text


def test_generated_lookups_are_not_broadcast(spark):
    text = plan(entry.queries()["fix_counts"](spark, SF))
    joins = re.findall(r"\) (\w+Join)\n(?:Left|Right) keys.*_salt", text)
    assert joins == ["SortMergeJoin"]

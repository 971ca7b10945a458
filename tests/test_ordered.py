"""Skew-safe building blocks against plain window functions and brute force."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from buildgraph.functions.ordered import block_of, fill_forward, number_rows, running_count
from buildgraph.functions.skew import StoredTable, hot_keys, lookup_join
from buildgraph.functions.storage import Rounds, materialize_counted, work_dir
from buildgraph.operators.chunking import chunk
from buildgraph.operators.state import last_rows
from buildgraph.operators.throttle import throttle


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    data = [
        (1 if rnd.random() < 0.5 else rnd.randrange(2, 9), i, rnd.choice([None, None, i]))
        for i in range(400)
    ]
    return spark.createDataFrame(data, "k int, seq bigint, v bigint").repartition(5, "seq")


@pytest.mark.parametrize("block_rows", [1, 7, 1000])
def test_fill_forward_equals_window(skewed, rows, block_rows):
    w = Window.partitionBy("k").orderBy("seq")
    want = skewed.withColumn("f", F.last("v", True).over(w))
    got = fill_forward(
        skewed.withColumn("b", block_of("seq", block_rows)), ["k"], "b", ["seq"], {"f": F.col("v")}
    ).drop("b")
    assert rows(got.select(*want.columns)) == rows(want)


@pytest.mark.parametrize("block_rows", [1, 7, 1000])
def test_running_count_equals_window(skewed, rows, block_rows):
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    flag = F.col("v").isNotNull()
    want = skewed.withColumn("n", F.coalesce(F.sum(flag.cast("int")).over(w), F.lit(0)).cast("bigint"))
    blocked = skewed.withColumn("b", block_of("seq", block_rows))
    got = running_count(blocked, ["k"], "b", ["seq"], flag, "n").drop("b")
    assert rows(got.select(*want.columns)) == rows(want)


def test_number_rows_per_key_and_global(skewed, rows):
    per_key = number_rows(skewed, ["k"], ["seq"])
    w = Window.partitionBy("k").orderBy("seq")
    want = skewed.withColumn("position", F.row_number().over(w).cast("bigint"))
    assert rows(per_key.select(*want.columns)) == rows(want)
    everything = number_rows(skewed, [], ["seq"])
    assert rows(everything, "position", "seq") == rows(
        skewed.select((F.col("seq") + 1).alias("position"), "seq")
    )


def test_last_rows_beyond_group_limit(skewed, rows):
    want = sorted(r["seq"] for r in skewed.filter("k = 1").collect())[-120:]
    got = last_rows(skewed.select("k", "seq"), "k", "seq", 120).filter("k = 1")
    assert [s for (s,) in rows(got.select("seq").orderBy("seq"))] == sorted(want, key=repr)
    big = last_rows(skewed.select("k", "seq"), "k", "seq", 1500, block_rows=50)
    assert big.count() == skewed.count()


def test_lookup_join_splits_hot_keys_and_keeps_all_rows(spark, skewed, rows):
    dim = spark.createDataFrame([(k, f"n{k}") for k in range(1, 6)], "k int, name string")
    assert rows(hot_keys(skewed, ["k"], min_rows=100), "k") == [(1,)]
    for how in ("left", "inner"):
        want = skewed.join(dim, "k", how)
        got = lookup_join(skewed, dim, ["k"], how, spread=["seq"], min_rows=100)
        assert rows(got.select(*want.columns)) == rows(want)
    stored = StoredTable(skewed, ["k"], ["seq"], min_rows=100)
    assert stored.n_hot == 1
    assert rows(stored.join(dim).select("k", "seq", "name")) == rows(
        skewed.join(dim, "k").select("k", "seq", "name")
    )


def test_lookup_join_keeps_null_keys(spark, rows):
    facts = spark.createDataFrame([(None, 1), (1, 2)], "k int, x int")
    dim = spark.createDataFrame([(1, "a")], "k int, name string")
    assert rows(lookup_join(facts, dim, ["k"], "left"), "x", "name") == [(1, None), (2, "a")]


def test_rounds_merge(spark):
    first, n = materialize_counted(spark.range(0, 1))
    assert n == 1
    rounds = Rounds(first)
    for i in range(1, 20):
        rounds.add(spark.range(i, i + 1))
    assert sorted(r["id"] for r in rounds.all().collect()) == list(range(20))


def test_work_dir_follows_the_session(spark):
    old = work_dir(spark)
    assert "buildgraph" in old


def greedy(events, gap):
    out, by_key = set(), {}
    for k, t, s in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        last = by_key.get(k)
        if last is None or t - last >= gap:
            by_key[k] = t
            out.add((k, t, s))
    for k in by_key:
        out.add(max(e for e in events if e[0] == k))
    return out


@pytest.mark.parametrize("fold_rows", [1, 40, 4096])
def test_throttle_equals_greedy(spark, rows, fold_rows):
    rnd = random.Random(5)
    events = [("a" if rnd.random() < 0.6 else "bcd"[rnd.randrange(3)], rnd.randrange(0, 60_000_000), i) for i in range(150)]
    events += [("a", 30_000_000, 500 + i) for i in range(30)]  # a burst at one instant
    df = spark.createDataFrame(events, "k string, ts_us bigint, seq bigint")
    got = {tuple(r) for r in throttle(df, ["k"], 3, fold_rows=fold_rows).collect()}
    assert got == greedy(events, 3_000_000)


def test_chunk_sizes(spark):
    df = spark.range(1, 501).select(F.col("id").alias("k"))
    ref = {r["chunk"]: r["count"] for r in chunk(df, ["k"]).groupBy("chunk").count().collect()}
    assert ref == {1: 191, 2: 192, 3: 117}
    even = {r["chunk"]: r["count"] for r in chunk(df, ["k"], offset="even").groupBy("chunk").count().collect()}
    assert even == {1: 192, 2: 192, 3: 116}
    assert chunk(df, ["k"]).filter("k = 192").first()["chunk_file"] == "build-chunk-2.json"

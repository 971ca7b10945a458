"""Samples at any size, statistics without a cap, bounded filters, and columns with clashing names."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, awkward

from buildgraph.llm import boosting, key_filter, language, lines, pii, quality, urls


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3).cache()


@pytest.mark.parametrize("n", [10**6, 10**10, 10**12, 10**14])
def test_samples_have_the_wanted_size_at_any_table_size(spark, n):
    """A table of a thousandth of n rows, said to have n, has a thousandth of the sample."""
    rows = spark.range(10**6)
    at_most = n // 1000
    got = boosting.bounded_sample(rows, "id", at_most, n=n).count()
    assert abs(got - 1000) < 200
    # A small sample of a very large table: the limit keeps its resolution.
    share = (boosting.hash_limit(20_000, n) + (1 << 63)) / (1 << 64)
    assert share == pytest.approx(20_000 / n, rel=1e-5) and share > 0


def test_small_tables_are_their_own_sample(spark):
    assert boosting.bounded_sample(spark.range(50), "id", 50).count() == 50
    assert boosting.hash_limit(5, 0) == boosting.hash_limit(7, 7) == (1 << 63) - 1


def test_every_suffix_has_its_statistic(spark):
    suffixes = [f"s{i}" for i in range(1200)]
    rows = [(f"http://site{j}.{s}/", s) for s in suffixes for j in range(2)] + [(f"http://pills.{s}/", s) for s in suffixes[:3]]
    labelled = spark.createDataFrame(rows, "url string, _suffix string").withColumn("_y", F.col("url").contains("pills").cast("int"))
    rates, mean = urls.suffix_rates(labelled)
    got = {r[0]: r[1] for r in rates.collect()}
    assert len(got) == 1200 and mean == pytest.approx(3 / len(rows))
    for i, s in enumerate(suffixes):
        y, n = (1, 3) if i < 3 else (0, 2)
        assert got[s] == pytest.approx((y + 10 * mean) / (n + 10))


def test_words_count_at_borders_only(spark):
    hosts = {"ads.x.net": True, "my-ads.net": True, "ads7.net": True, "downloads3.net": False, "adsense.net": False, "x.casino": True, "badspam.net": False, "": False}
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", urls.is_unwanted(F.col("h")).alias("u"))
    assert {r.h: r.u for r in rows.collect()} == hosts


def test_urls_with_repeated_rows_and_null_keys(spark):
    rows = [(1, "http://a.net/x", 5), (1, "http://a.net/x", 5), (None, "http://a.net/x", 5), (None, None, 5), (2, "http://pills.net/" + "y" * 100_000, 5)]
    rows += [(10 + i, f"http://site{i}.net/p", 1) for i in range(30)]
    out = urls.op8(spark.createDataFrame(rows, "page_id long, url string, host int").withColumns({"_suffix": F.lit(1), "_y": F.lit(0), "verdict": F.lit("v")}))
    got = sorted(map(repr, out.collect()))
    assert len(got) == len(rows)
    same = [r for r in out.collect() if r.host == "a.net"]
    assert len(same) == 3 and len({(r.path, r.rule, r.verdict) for r in same}) == 1


def test_a_filter_lets_no_key_through(spark):
    keys = spark.range(0, 30_000, 3).withColumnRenamed("id", "k")
    clean, hit = key_filter.split_by_filter(spark.range(30_000).withColumnRenamed("id", "x"), "x", key_filter.key_filter(keys, "k"))
    assert clean.where("x % 3 = 0").count() == 0 and hit.where("x % 3 = 0").count() == 10_000
    assert clean.count() + hit.count() == 30_000 and hit.count() < 10_100
    none = key_filter.key_filter(keys.limit(0), "k")
    assert key_filter.split_by_filter(spark.range(5), "id", none)[0].count() == 5


def test_columns_of_any_name_pass_through(spark, docs):
    odd = docs.select("doc_id", "text", "source", *[F.lit(i).alias(n) for i, n in enumerate(["gone", "_k", "_host", "_lines", "_row", "_q_w", "a.b", "_gone", "_kept_text"])])
    got = lines.without_repeated_lines(odd)
    want = lines.without_repeated_lines(docs.select("doc_id", "text"))
    names = ["doc_id", "text", "_kept_text", "_n_lines", "_n_gone"]
    assert sorted(map(repr, got.select(names).collect())) == sorted(map(repr, want.select(names).collect()))
    assert got.columns == [c for c in odd.columns if c != "_kept_text"] + list(lines.ADDED)
    assert got.select("gone", "_k", "`a.b`", "_gone").distinct().collect() == [(0, 1, 6, 7)]
    keep = ["doc_id", "_host", "_row", "a.b"]
    judged = quality.judge(odd, "text", "source", keep)
    assert judged.columns == [*keep, "_q", "_kept"]
    plain = quality.judge(docs, "text", "source", ["doc_id"])
    assert sorted(map(repr, judged.select("doc_id", "_q", "_kept").collect())) == sorted(map(repr, plain.collect()))


@pytest.mark.parametrize("languages", [1, 2, 7, 8, 20, 100])
def test_codewords_are_apart(languages):
    codes = language.codebook(languages)
    assert codes.shape[0] == languages
    if languages > 1:
        apart = min((codes[i] != codes[j]).sum() for i in range(languages) for j in range(i))
        assert apart >= codes.shape[1] / 4
        assert languages == 2 or (abs(codes.sum(axis=0, dtype=int)) < languages).all()


def model(languages):
    rng = np.random.default_rng(2)
    codes = language.codebook(languages)
    weights = rng.normal(0, 1, (1 << language.BUCKET_BITS, codes.shape[1])).astype(np.float32)
    return language.LanguageModel([f"l{i}" for i in range(languages)], codes, weights, rng.uniform(0.5, 1.5, codes.shape[1]))


def test_decoding_takes_the_codeword_of_least_loss():
    rng = np.random.default_rng(3)
    m = model(9)
    for _ in range(50):
        margins = rng.normal(0, 1, m.codes.shape[1])
        losses = [sum(w * np.log1p(np.exp(-c * x)) for w, c, x in zip(m.trust, code, margins, strict=True)) for code in m.codes]
        best, score = language.decode(m, margins)
        assert best == int(np.argmin(losses))
        assert score == pytest.approx(1 / sum(np.exp(min(losses) - x) for x in losses))


def test_a_long_text_needs_little_memory():
    m = model(20)
    data = np.random.default_rng(4).integers(32, 250, 20 << 20).astype(np.uint8)
    part = data[: 3 * language.PIECE + 77]
    whole = m.weights[language.trigram_buckets(part)].mean(axis=0, dtype=np.float64) / language.MARGIN
    assert np.allclose(language.mean_margins(m, part), whole)
    assert not language.mean_margins(m, data[:2]).any()
    tracemalloc.start()
    language.mean_margins(m, data)
    assert language.has_letter(data)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_pii_learns_from_all_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "fit", lambda rows, *a, **k: seen.append(rows.count()) or "0D")
    monkeypatch.setattr(pii, "calibrated_threshold", lambda rows, *a: seen.append(rows.count()) or 2.0)
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("call +49 171 "), F.col("id") + 1_000_000).alias("text"))
    pii.learned(docs, "doc_id", "text")
    assert [a + b for a, b in zip(seen[::2], seen[1::2], strict=True)] == [9000] * len(pii.KINDS)

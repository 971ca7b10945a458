"""The corpus operators against brute force, on small and awkward tables."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from buildgraph.functions.storage import materialize
from buildgraph.llm import (
    components,
    decontamination,
    language,
    lines,
    mixing,
    near_duplicates,
    pii,
    quality,
    simhash,
    substrings,
    tokens,
    urls,
)
from buildgraph.llm.components import connected
from buildgraph.llm.fm_index import FMIndex, suffix_array

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, items int, _q int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def awkward():
    """Nulls, empty and long texts, ties, repeated rows and clashing column names."""
    rng = random.Random(3)
    vocabulary = ["alpha", "beta", "Gamma", "δέλτα", "e", "zz9", "naïve", "漢字", "x-y", "Ω"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(4)]
    texts = [None, "", "   \n\t ", "one", "one two", "ONE two", base[0], base[0], base[1]]
    texts += [base[0] + "\n" + base[2], base[2] + " tail\n" + base[1], base[3][:200] + " changed " + base[3][200:]]
    texts += [base[3], "w " * 4000, "\n".join([base[2], base[3]] * 3), "line a\nline b\nline c\nline d\n" * 2]
    texts += ["\n".join(["line a", "line b", "line c", "line d", "own"]), "\x0b" + base[1] + "\r\n", "a" * 30000]
    rows = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else None, None, "k", 1, 2) for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, base[0], "fr", "s2", 1, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def order(row):
    return (row[0] is not None, row[0] or 0)


def unions(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


# --- simhash ---------------------------------------------------------------


def test_golay_decoding_finds_the_nearest_codeword():
    table = simhash.error_patterns()
    words = np.random.default_rng(1).integers(0, 1 << 23, 300, dtype=np.uint32)
    codes = words ^ table[simhash.syndromes(words)]
    assert not simhash.syndromes(codes).any()
    assert (np.bitwise_count(words ^ codes) <= 3).all()


def test_fingerprints_two_bits_apart_share_a_key():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    other = prints.copy()
    for _ in range(2):
        other ^= np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)
    table = simhash.error_patterns()

    def keys(p):
        found = collections.defaultdict(dict)
        for r, k, e in zip(*simhash.golay_keys(p, table), strict=True):
            found[r][k] = e
        return found

    a, b = keys(prints), keys(other)
    for i in range(200):
        assert any(k in b[i] and (a[i][k] or b[i][k]) for k in a[i])


@pytest.mark.parametrize("paired", [1, 16])
def test_simhash_groups(spark, docs, empty, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(5)
    close = [(1000 + i, " ".join(f"w{rng.randrange(9)}" for _ in range(3))) for i in range(40)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(close, "doc_id long, text string"))
    rows = table.collect()
    import xxhash

    def fingerprint(text):
        w = SPACE.findall(lower(text))
        parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {(r.doc_id, r.text): fingerprint(r.text) for r in rows}
    distinct = sorted(set(prints.values()))
    near = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if bin(a ^ b).count("1") <= 2]
    group = unions(near, distinct)
    least = {}
    for (d, _), p in prints.items():
        if d is not None:
            least[group[p]] = min(least.get(group[p], d), d)
    want = sorted((str(d), f"{p:016x}", str(least.get(group[p]))) for (d, t) in [(r.doc_id, r.text) for r in rows] for p in [prints[d, t]])
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.op9(table).collect())
    assert got == want
    assert simhash.op9(empty).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = unions(pairs, {n for p in pairs for n in p if p[0] != p[1]} | {n for p in pairs for n in p})
    assert all(got.get(n, n) == want[n] for n in want)


def test_components_of_stars_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "materialize", lambda rows, label: written.append(label) or materialize(rows, label))
    pairs = [(0, i) for i in range(1, 40)] + [(i, 50) for i in range(51, 60)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: 0 if n < 50 else 50 for p in pairs for n in p}
    assert not written


def test_near_duplicates_start_with_simhash(spark, monkeypatch):
    rng = random.Random(13)
    texts = [[f"word{rng.randrange(4000)}" for _ in range(300)] for _ in range(40)]
    texts += [[*w[:299], "other"] for w in texts[:20]]
    given = []
    later = near_duplicates.similar_links
    monkeypatch.setattr(near_duplicates, "similar_links", lambda t, n, p, found: given.append(found) or later(t, n, p, found))
    group, pairs = similar_groups(spark, texts)
    assert len(pairs) == 20 and all(group[a] == group[b] for a, b in pairs)
    assert len(set(group.values())) == 40
    # Most copies with one other word differ in two bits or fewer; no other texts are linked.
    assert 0 < given[0].count() <= 20
    nodes = {group[a] for a, _ in pairs}
    assert all(r.a in nodes or r.b in nodes for r in given[0].collect())


def test_near_duplicates_meet_the_similarity(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        words = [f"word{rng.randrange(4000)}" for _ in range(200)]
        texts.append(words)
        for _ in range(2):
            copy = list(words)
            for _ in range(rng.randrange(1, 9)):
                copy[rng.randrange(200)] = f"new{rng.randrange(10**6)}"
            texts.append(copy)
    table = spark.createDataFrame([(i, i, " ".join(w)) for i, w in enumerate(texts)], "k long, doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = unions(pairs, range(len(texts)))
    rows = near_duplicates.near_duplicate_leaders(table).collect()
    group = {r.k: r.group for r in rows}
    found = sum(group[a] == group[b] for a, b in pairs)
    assert found >= 0.9 * len(pairs)
    leaders = {r.group: r.k for r in rows if r.leader}
    assert all(want[r.k] == want[leaders[r.group]] for r in rows)


def test_near_duplicates_of_a_crowd(spark, docs, empty):
    crowd = [(i, i, "same words in every one of these many texts but number " + "n%d" % i) for i in range(60)]
    table = spark.createDataFrame(crowd, "k long, doc_id long, text string")
    rows = near_duplicates.near_duplicate_leaders(table, similarity=0.7).collect()
    assert len({r.group for r in rows}) == 1 and [r.k for r in rows if r.leader] == [0]
    keyed = docs.select(lines.row_key(F.col("doc_id"), F.col("text")).alias("k"), "doc_id", "text")
    leaders = near_duplicates.near_duplicate_leaders(keyed)
    assert leaders.count() == keyed.select("k").distinct().count()
    assert near_duplicates.near_duplicate_leaders(empty.select(F.lit(1).cast("long").alias("k"), "doc_id", "text")).count() == 0


def similar_groups(spark, texts):
    """Texts as lists of words: (groups of near_duplicate_leaders, pairs of similar texts)."""
    table = spark.createDataFrame([(i, i, " ".join(w)) for i, w in enumerate(texts)], "k long, doc_id long, text string")
    group = {r.k: r.group for r in near_duplicates.near_duplicate_leaders(table).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = collections.Counter((a, b) for own in holders.values() if len(own) < 999 for a, b in itertools.combinations(own, 2))
    return group, [(a, b) for (a, b), n in common.items() if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def test_near_duplicates_with_one_changed_passage(spark):
    rng = random.Random(11)
    texts = []
    for case in range(120):
        words = [f"word{rng.randrange(4000)}" for _ in range(rng.choice([100, 200, 400]))]
        n = int(len(words) * rng.uniform(0.06, 0.24))
        passage = [f"new{rng.randrange(10**6)}" for _ in range(n)]
        at = rng.randrange(len(words) - n)
        m = n * 2 // 5
        texts += [words, words + passage if case % 2 else words[:at] + passage[:m] + words[at + m :]]
    group, pairs = similar_groups(spark, texts)
    assert len(pairs) > 60 and all(group[a] == group[b] for a, b in pairs)
    assert len(set(group.values())) == len(texts) - len(pairs)


@pytest.mark.parametrize("work", [0, 64])
def test_near_duplicates_within_a_crowd(spark, monkeypatch, work):
    monkeypatch.setattr(near_duplicates, "WORK", work)
    rng = random.Random(12)
    template = [f"template{i}" for i in range(160)]
    texts = [[*template, *[f"own{rng.randrange(10**6)}" for _ in range(60)]] for _ in range(2000)]
    for i in range(0, 60, 3):  # three copies each
        texts[i + 1] = [*texts[i][:180], "other", *texts[i][181:]]
        texts[i + 2] = [*texts[i][:200], *[f"end{rng.randrange(10**6)}" for _ in range(12)]]
    edited = [f"base{i}" for i in range(100)]
    for _ in range(80):  # a large group of edited copies, not all similar to each other
        edited = list(edited)
        edited[rng.randrange(100)] = f"edit{rng.randrange(10**6)}"
        texts.append(edited)
    group, pairs = similar_groups(spark, texts)
    assert len(pairs) > 100
    want = unions(pairs, range(len(texts)))
    assert len({(group[i], want[i]) for i in want}) == len(set(group.values())) == len(set(want.values()))


# --- decontamination -------------------------------------------------------


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 4, 400)
    text[-1] = 0
    order = suffix_array(text)
    assert sorted(order) == list(range(400))
    index = FMIndex(text, 4)
    patterns = np.zeros((50, 4), dtype=np.int64)
    lengths = rng.integers(1, 5, 50)
    for i, n in enumerate(lengths):
        patterns[i, 4 - n :] = rng.integers(1, 4, n)
    lo, hi = index.search(patterns, lengths)
    for i, n in enumerate(lengths):
        p = patterns[i, 4 - n :]
        want = [a for a in range(400 - n + 1) if (text[a : a + n] == p).all()]
        assert sorted(index.locate(np.arange(lo[i], hi[i]))) == want


def test_decontamination(spark, docs, empty):
    items = [(1, "alpha beta"), (2, None), (3, ""), (4, docs.where("doc_id = 9").first().text[:150]), (5, "alpha beta"), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t))
        for a in range(max(len(w) - 9, min(len(w), 1))):
            windows[tuple(w[a : a + 10])].add(i)
    want = []
    for r in docs.collect():
        w, hit, found = word.findall(lower(r.text)), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= {str(i) for i in windows[tuple(w[a : a + n])] if i is not None}
        want.append((r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = [tuple(r) for r in decontamination.op3(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    whole = decontamination.find_contamination(docs, bench)
    blocks = decontamination.find_contamination(docs, bench, block_words=1)
    assert sorted(map(str, whole.collect())) == sorted(map(str, blocks.collect()))
    cut = whole.select("doc_id", "text", "spans", decontamination.without_spans(F.col("text"), F.col("spans")).alias("left"))
    for r in cut.where("text is not null").collect():
        raw, at, parts = r.text.encode(), 0, []
        for s in r.spans:
            parts.append(raw[at : s.start_byte])
            at = s.end_byte
        assert r.left == b"".join([*parts, raw[at:]]).decode()
    assert decontamination.op3(empty, bench).count() == 0
    assert decontamination.op3(docs, bench.limit(0)).where("contaminated").count() == 0


# --- lines, passages -------------------------------------------------------


def test_line_dedup(docs, empty):
    rows = {(r.doc_id, r.text): r for r in docs.collect()}
    seen, gone = set(), collections.defaultdict(set)
    for key in sorted(rows, key=order):
        own = [(i, x.strip(" \t\x0b\f\r")) for i, x in enumerate((key[1] or "").split("\n"))]
        own = [(i, x) for i, x in own if x]
        for m in range(1, 5):
            for p in range(len(own) - m + 1):
                run = tuple(x for _, x in own[p : p + m])
                if m >= 4 or sum(len(SPACE.findall(x)) for x in run) >= 50:
                    if run in seen:
                        gone[key] |= {i for i, _ in own[p : p + m]}
                    seen.add(run)
    kept = {k: None if k[1] is None else "\n".join(x for i, x in enumerate(k[1].split("\n")) if i not in gone[k]) for k in rows}
    keys = [(r.doc_id, r.text) for r in docs.collect()]
    got = lines.op4(docs).select("doc_id", "n_removed", "kept_text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((k[0], len(gone[k]), kept[k])) for k in keys)
    assert any(gone.values())
    assert lines.op4(empty).count() == 0


@pytest.mark.parametrize("crowded", [1, 1000])
def test_substring_dedup(docs, empty, monkeypatch, crowded):
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 200)
    keys = sorted({(r.doc_id, r.text) for r in docs.collect()}, key=order)
    seen, want = set(), {}
    for k in keys:
        w, gone = SPACE.findall(k[1] or ""), set()
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                gone |= set(range(i, i + 20))
            seen.add(window)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[k] = (k[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = [tuple(r) for r in substrings.op5(docs).collect()]
    assert sorted(map(str, got)) == sorted(str(want[r.doc_id, r.text]) for r in docs.collect())
    assert substrings.op5(empty).count() == 0


def test_suffix_automaton_matches():
    rng = random.Random(6)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 25))] for _ in range(30)]
    automaton = substrings.SuffixAutomaton()
    for n, words in enumerate(texts):
        for end, length in enumerate(automaton.matches(words), 1):
            inside = lambda part: any(part == t[i : i + len(part)] for t in texts[:n] for i in range(len(t)))  # noqa: B023, E731
            assert not length or inside(words[end - length : end])
            assert length == end or not inside(words[end - length - 1 : end])
        automaton.add(words)


# --- quality, mixing, tokens -----------------------------------------------


def test_quality_counts(docs, empty):
    for r in quality.judge(docs.select("text", "source"), "text", "source", ["text"]).collect():
        w = SPACE.findall(r.text or "")
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        own = [x for x in (r.text or "").split("\n") if SPACE.search(x)]
        symbols = len(re.findall(r"[#*$%&|<>]", r.text or ""))
        assert tuple(r._q)[:5] == (len(w), sum(map(len, w)), symbols, len(own) - len(set(own)), len(covered))
        if len(w) < 10 or 100 * len(covered) > 20 * len(w):
            assert not r._kept
    assert quality.op7(docs).count() == docs.count()
    assert quality.op7(empty).count() == 0


def test_a_bad_host_lowers_the_limit(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    noisy = " ".join(f"word{i}#" if i % 4 == 0 else f"word{i}" for i in range(40))
    rows = [(i, noisy, "bad") for i in range(30)] + [(100, clean, "bad")]
    rows += [(200 + i, clean, f"good{i % 5}") for i in range(60)] + [(300, noisy, "good0"), (301, noisy, "new")]
    got = {r.doc_id: r.kept for r in quality.op7(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i] for i in range(30))
    assert got[100] and got[300] and got[301] and all(got[200 + i] for i in range(60))


@pytest.mark.parametrize("few", [0, 20_000])
def test_mixing_sample_has_the_targets(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_CELLS", few)
    rng = random.Random(4)
    share = {"=en": 0.55, "=de": 0.2, "=fr": 0.15, "=es": 0.08, "=it": 0.02}
    rows = [(f"=s{rng.randrange(12) ** 2 // 9}", rng.choices(list(share), share.values())[0], f"={rng.choice('abbbb')}", rng.randrange(1, 400)) for _ in range(4000)]
    measured = spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long")
    wanted = {"en": 0.2, "de": 0.2, "fr": 0.2, "es": 0.2, "it": 0.2}
    rates = {(r.source, r.lang, r.topic): r.probability for r in mixing.sampling_table(measured, wanted).collect()}
    assert all(0 <= p <= 1 for p in rates.values())
    cells = mixing.token_cells(measured)
    targets = [("source", mixing.tempered_targets(cells, "source", mixing.SOURCE_POWER))]
    targets += [("topic", mixing.tempered_targets(cells, "topic", mixing.TOPIC_POWER)), ("lang", mixing.stated_targets(cells, "lang", wanted))]
    total = sum(r[3] for r in rows)
    for at, (dimension, target) in zip((0, 2, 1), targets, strict=True):
        got, had = collections.Counter(), collections.Counter()
        for r in rows:
            got[r[at]] += r[3] * rates[r[:3]] / total / mixing.KEEP_SHARE
            had[r[at]] += r[3] / total / mixing.KEEP_SHARE
        told = {r[0]: (r.target, r.reached) for r in mixing.reachable(cells, dimension, target).collect()}
        low = {v for v, (t, reached) in told.items() if reached < t - 1e-9}
        assert low == {v for v, (t, _) in told.items() if had[v] < t} and (dimension != "lang" or low == {"=it", "=es"})
        assert all(abs(got[v] - reached) < 0.002 for v, (_, reached) in told.items())


def test_mixing_hits_the_targets(spark, docs, empty):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(20, 200), rng.choice(["en", "en", "en", "de", "fr", "es", None]), f"s{rng.randrange(5)}") for i in range(1500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.op10(table).collect()
    total = sum(r.n_tokens for r in out)
    expected = collections.Counter()
    for r in out:
        expected[r.lang] += r.n_tokens * r.probability
    assert abs(sum(expected.values()) / total - mixing.KEEP_SHARE) < 0.02
    assert max(r.probability for r in out) <= 1
    sampled = sum(r.n_tokens for r in out if r.sampled)
    assert abs(sampled / total - mixing.KEEP_SHARE) < 0.05
    cells = mixing.token_cells(table.select(mixing.value_key(F.col("source")).alias("source"), mixing.value_key(F.col("lang")).alias("lang"), F.lit("t").alias("topic"), F.lit(1).alias("n_tokens")))
    target = mixing.stated_targets(cells, "lang", mixing.LANGUAGES)
    weights = mixing.raked(cells, {"source": mixing.tempered_targets(cells, "source", 0.7), "lang": target})
    for r in weights.groupBy("lang").agg(F.sum("weight").alias("w")).join(target, "lang").collect():
        assert abs(r.w - r.target) < 1e-3
    assert mixing.op10(docs).count() == docs.count()
    assert mixing.op10(empty).count() == 0


def test_token_counts_equal_the_library(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), tokens.PrefixCounter(path)

    def count(text):
        return len(library.encode(text, add_special_tokens=False).ids)

    for r in tokens.count_tokens(docs.select("doc_id", "text")).collect():
        text = r.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), count(text))
        assert 0 <= r.limit_bytes <= r.n_bytes
    rng = random.Random(1)
    letters = [*"abAB 12  \n\t'sreéñß漢字½²_-!?.,\x1c\x85", "<|endoftext|>", "'re", "   ", "ing"]
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        ends, totals = counter.prefixes(text)
        assert totals[-1] == counter.total(text) == count(text)
        for end, total in zip(ends, totals, strict=True):
            assert count(text.encode()[:end].decode()) == total
    word = "thereoninghestation"
    assert counter.piece_prefixes(word.encode()) == [count(word[:i]) for i in range(len(word) + 1)]
    table = tokens.prefix_table(docs.where("doc_id = 6"))
    assert tokens.tokens_before(table, 10**9).first().n_tokens == counter.total(docs.where("doc_id = 6").first().text)
    assert tokens.op2(empty).count() == 0


# --- language, urls, personal data ------------------------------------------


def test_language(spark, docs, empty):
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "and", "wh"], "de": ["sch", "ung", "der", "ß"], "fr": ["eau", "que", "les", "é"], "es": ["ción", "los", "ñ", "ando"]}
    rows = []
    for i in range(800):
        lang = list(parts)[i % 4]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(20)), lang))
    rows += [(900, None, "en"), (901, "12 34", "en"), (902, "", None), (None, "the and the wh", "en"), (903, "a", "en")]
    out = language.op6(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (900, 901, 902)} == {"und"}
    assert language.op6(docs).count() == docs.count()
    assert language.op6(empty).count() == 0
    one = language.train(spark.createDataFrame([("xx", "abc def")], "lang string, text string"))
    assert one.languages == ["xx"]
    assert language.codebook(20).shape[0] == 20


def test_urls(spark):
    rows = [
        (0, None), (1, ""), (2, "no scheme"), (3, "http://Example.ORG/es/1?q#f"), (4, "https://a.example.org/en/12"), (5, "http://x.org"),
        (6, "http://x.org/"), (7, "http://shop.com/de/4"), (8, "http://shop.com/fr/4#x"), (9, "http://notexample.org/es/"), (10, "a://b://c/d?e"), (11, "://h?x"),
    ]
    rows += [(20 + i, f"http://spam-{i}.net/en/{i}?a=1&b=2") for i in range(40)] + [(100 + i, f"http://site{i}.net/en/page{i}") for i in range(40)]
    got = {r.page_id: r for r in urls.op8(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    rules = {i: got[i].rule for i in range(12)}
    assert rules == {0: None, 1: None, 2: None, 3: "example.org/es/", 4: "example.org/en/1", 5: None, 6: "org/", 7: "com/de/", 8: "com/fr/", 9: "org/", 10: None, 11: None}
    assert [got[i].verdict for i in (3, 4, 6, 7, 8, 9)] == ["block", "block", "allow", "block", "allow", "allow"]
    assert (got[10].host, got[10].path) == ("b:", "//c/d") and (got[11].host, got[11].path) == ("h", "")
    assert (got[0].host, got[0].path, got[5].path) == ("", "", "")
    assert all(got[20 + i].verdict == "block" for i in range(40))
    assert urls.op8(spark.createDataFrame([], "page_id long, url string")).count() == 0


def base_spans(text):
    def luhn(s):
        values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(s))]
        return sum(v - 9 if v > 9 else v for v in values) % 10 == 0

    def number(m):
        return re.sub("[^0-9]", "", m[0])

    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(number(m)) <= 19 and luhn(number(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(number(m)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m)] for k, (p, ok) in checks.items()}


def test_pii_base_spans(spark, empty):
    rng = random.Random(2)
    parts = [*"ab@.+-(1234567890) é😀%_", "a@b.c", "+1 (988) 555-2485", "4111 1111 1111 1111", "1.2.3.4", "255.", "300.1.2.3", "x@y.z_w@v.u", "[at]"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(600)]
    rows += [(9000, None), (9001, ""), (9002, "1 " * 9000 + "+1" + "5" * 9 + " " + "a" * 20000 + "@b" + ".c" * 9000), (9003, "1.2.3.4 " * 700)]
    for r in pii.op1(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = base_spans(dict(rows)[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k in want for a, b in want[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, want.values()))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    assert pii.op1(empty).count() == 0


def test_pii_redaction(spark):
    table = spark.createDataFrame([(1, "mail a@b.co now, call +1 (988) 555-2485."), (2, "nothing"), (3, None)], "doc_id long, text string")
    found = pii.find_pii(table, ["doc_id", "text"])
    got = {r.doc_id: r.out for r in found.select("doc_id", pii.redacted(F.col("text"), F.col("_spans")).alias("out")).collect()}
    assert got == {1: "mail [email] now, call [phone].", 2: "nothing", 3: None}

"""Fill-in-the-middle, SuperMinHash groups and vector codes against brute force, on awkward tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, SPACE, awkward, lower, unions

from buildgraph.llm import fill_middle, superminhash, vector_codes


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- fill in the middle ------------------------------------------------------


def test_block_tree_cuts_at_every_unit():
    rng = random.Random(4)
    texts = ["", "a", "漢字", " \n lead", "tail \n\n", "one two\nthree  four\n"]
    texts += ["".join(rng.choice(["a", "é", "漢", "🙂", " ", "\n"]) for _ in range(n)) for n in (7, 64, 65, 300)]
    for text, block in itertools.product(texts, (1, 3, 16, 512)):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        bounds = {
            "char": list(range(len(text) + 1)),
            "line": [0, *[m.end() for m in re.finditer("\n", text) if m.end() < len(text)], len(text)] if text else [0],
            "word": [0, *[m.start() for m in SPACE.finditer(text)][1:], len(text)] if text else [0],
        }
        for unit, want in bounds.items():
            tree = fill_middle.BlockTree(data, unit, block)
            assert (tree.units, tree.code_points) == (len(want) - 1, len(text))
            got = [tree.cut(k) for k in range(len(want))]
            assert got == [(len(text[:w].encode()), w) for w in want]


def want_cut(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    t = text or ""
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, docs, empty):
    more = [(100 + i, t) for i, t in enumerate(["<P>", "a<M>b", "<<S<P", "🙂" * 700, "é\n" * 5, "x" * 3_000_000])]
    more += [(200 + i, "some <text> 漢字 <S") for i in range(60)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = sorted(((r.doc_id, *want_cut(r.doc_id, r.text)) for r in table.collect()), key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert sorted((tuple(r) for r in fill_middle.fill_in_middle(table).collect()), key=repr) == want
    texts = sorted(((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in table.collect()), key=repr)
    assert sorted(((r.doc_id, r.restored_sha256) for r in fill_middle.op11(table).collect()), key=repr) == texts
    assert fill_middle.op11(empty).count() == 0


def test_cuts_at_words_and_lines_restore_the_text(docs):
    for unit in ("word", "line"):
        out = fill_middle.fill_in_middle(docs, unit=unit, rate=100, spm=50)
        back = out.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text"))
        want = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
        assert sorted((tuple(r) for r in back.collect()), key=repr) == want
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, unit="page")


def test_clashing_names_are_not_read(docs):
    odd = docs.select("doc_id", "text", F.lit(1).alias("n"), F.lit("f").alias("form"), F.lit("x").alias("output"), F.lit(b"z").alias("node"))
    assert sorted(map(repr, fill_middle.op11(odd).collect())) == sorted(map(repr, fill_middle.op11(docs).collect()))
    assert sorted(map(repr, superminhash.op12(odd).collect())) == sorted(map(repr, superminhash.op12(docs).collect()))


# --- SuperMinHash ------------------------------------------------------------


def shingle_set(text):
    w = SPACE.findall(lower(text))
    return {" ".join(w[i : i + 4]) for i in range(len(w) - 3)} or ({" ".join(w)} if w else set())


def want_groups(rows):
    """(doc_id, size, component) by comparing all sets."""
    sets = [frozenset(shingle_set(r.text)) for r in rows]
    close = [
        (i, j)
        for i, j in itertools.combinations(range(len(rows)), 2)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    root = unions(close, range(len(rows)))
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[root[i]] = min(least.get(root[i], r.doc_id), r.doc_id)
    return sorted(((r.doc_id, len(sets[i]), least.get(root[i])) for i, r in enumerate(rows)), key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(999)}"
    return " ".join(words)


@pytest.mark.parametrize("paired", [2, 16])
def test_groups_of_similar_sets(spark, docs, empty, monkeypatch, paired):
    monkeypatch.setattr(superminhash, "PAIRED", paired)
    rng = random.Random(8)
    rows = []
    # Crowds: texts that share half of their words, with small groups of copies within, and chains of edits.
    shared = [f"c{i}" for i in range(90)]
    for i in range(60):
        own = shared + [f"t{i}-{j}" for j in range(70)]
        rows.append(" ".join(own))
        if i % 10 == 0:
            rows += [edited(rng, own, 3) for _ in range(2)]
    base = [f"b{i}" for i in range(150)]
    rows += [edited(rng, base, rng.randrange(1, 7)) for _ in range(80)] + [" ".join(base)] * 20
    chain = [f"q{i}" for i in range(100)]
    for i in range(12):
        rows.append(" ".join(chain))
        chain = chain[4:] + [f"q{i}-{j}" for j in range(4)]
    rows += [" ".join(base[:3]), " ".join(base[:3]).upper(), "w " * 500, "w w w w"]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(extra).repartition(4)
    got = superminhash.op12(table).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want_groups(table.collect())
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert superminhash.op12(empty).count() == 0


def test_signature_is_the_least_rank_per_slot():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 7, 40, 500, 3000)]
    sets.insert(2, np.zeros(0, dtype=np.uint64))
    together = superminhash.signatures(sets, 48)
    for own, row in zip(sets, together, strict=True):
        alone = superminhash.signatures([own], 48)[0]
        assert (alone == row).all()
        if len(own):
            # Of one set: the least of what its elements give each slot, and all ranks of an element differ.
            each = superminhash.signatures([own[i : i + 1] for i in range(len(own))], 48)
            assert (each.min(axis=0) == row).all()
            assert (np.sort(each >> np.uint64(56), axis=1) == np.arange(48)).all()


def test_signatures_estimate_better_than_independent_hashes():
    rng = np.random.default_rng(5)
    shares = []
    for _ in range(150):
        own = np.unique(rng.integers(0, 1 << 63, 110, dtype=np.uint64))
        a, b = superminhash.signatures([own[10:], own[:-10]], 100)
        shares.append((a == b).mean())
    likeness = 90 / 110
    assert abs(np.mean(shares) - likeness) < 0.01
    assert np.std(shares) < (likeness * (1 - likeness) / 100) ** 0.5


def test_sketches_agree_where_signatures_do(spark):
    rng = np.random.default_rng(9)
    values = rng.integers(0, 1 << 60, (40, 35), dtype=np.uint64)
    values[1::2] = np.where(rng.random((20, 35)) < 0.8, values[::2], values[1::2])
    known = spark.createDataFrame([(bytes([i]), s) for i, s in enumerate(superminhash.sketches(values).to_pylist())], "node binary, sketch array<long>")
    pairs = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(39)], "a binary, b binary")
    for percent in (80, 60, 99):
        need = superminhash.least_agreement(35, percent)
        want = {i for i in range(39) if ((values[i] & np.uint64(15)) == (values[i + 1] & np.uint64(15))).sum() >= need}
        assert {r.a[0] for r in superminhash.promising(pairs, known, 35, percent).collect()} == want
    assert superminhash.least_agreement(160, 80) == 97


# --- vector codes ------------------------------------------------------------


def want_codes(rows, parts, entries, rounds, scale=256):
    """(vec_id, code, error) and codebooks by full scans in Python integers."""
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and len(r[1]) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    most = vector_codes.widest(w * parts)
    x = [[max(-most, min(most, int(np.floor(np.float64(v) * scale)))) for v in r[1]] for r in kept]
    cut = [[tuple(v[p * w : p * w + w]) for p in range(parts)] for v in x]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def far(a, b):
        return sum((i - j) ** 2 for i, j in zip(a, b, strict=True))

    def codes():
        return [[min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e)) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        now = codes()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, c in zip(cut, now, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = tuple(sum(t) // len(mine) for t in zip(*mine, strict=True))
    out = [
        (r[0], "".join(f"{c:02x}" for c in code), sum(far(v[p], books[p][code[p]]) for p in range(parts)), r[2])
        for r, v, code in zip(kept, cut, codes(), strict=True)
    ]
    return out, books


@pytest.mark.parametrize("entries,rounds", [(8, 4), (64, 2), (1, 1)])
def test_vector_codes(spark, entries, rounds):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(0, 0.1, 32).astype(np.float32)], int(i % 4) if i % 5 else None) for i in range(150)]
    rows += [(i, [0.0] * 32, 7) for i in range(150, 220)]  # ties between entries
    rows += [rows[0], (3, rows[9][1], 2), (None, rows[8][1], 1), (301, None, 1), (302, [], 1), (303, [None] + [0.1] * 31, 1)]
    rows += [(304, [float("nan")] + [0.1] * 31, 1), (305, [float("-inf")] * 32, 1), (-7, [0.5] * 33, 1), (307, [0.5] * 48, 1)]
    rows += [(308, [3e38] * 16 + [-3e38] * 16, 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    table = table.withColumns({"code": F.lit(1), "vec": F.lit(2), "error": F.lit("e")})
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want, books = want_codes(as_float, 16, entries, rounds)
    codes, got_books = vector_codes.encode(table, entries=entries, rounds=rounds)
    got = vector_codes.with_label_error(codes).collect()
    sums = {}
    for _, _, error, label in want:
        sums[label] = sums.get(label, 0) + error
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == sorted(
        ((i, c, e, sums[label]) for i, c, e, label in want), key=repr
    )
    assert got_books.now.tolist() == [[list(e) for e in b] for b in books]
    text = ",".join(str(x) for b in books for e in b for x in e)
    assert got_books.digest() == hashlib.sha256(text.encode()).hexdigest()


def test_no_vectors(spark):
    table = spark.createDataFrame([(1, None, 2), (2, [1.0] * 5, 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.op13(table).count() == 0
    assert vector_codes.op13(table.limit(0)).count() == 0


def test_bounds_save_scans_and_net_displacement_is_tighter():
    rng = np.random.default_rng(7)
    centres = rng.integers(-4000, 4000, (12, 8))
    x = centres[rng.integers(0, 12, 3000)] + rng.integers(-150, 150, (3000, 8))
    books = vector_codes.Codebooks(np.ascontiguousarray(x[:24].reshape(24, 2, 4).swapaxes(0, 1)))
    code = bound = stamp = None
    scanned = []
    for _ in range(6):
        code, bound, stamp, error, n = vector_codes.assign(x, books, code, bound, stamp)
        full = vector_codes.assign(x, books)
        assert (code == full[0]).all() and (error == full[3]).all()
        scanned.append(int(n.sum()))
        sums = {}
        for p, e in itertools.product(range(2), range(24)):
            mine = x.reshape(-1, 2, 4)[code[:, p] == e, p]
            if len(mine):
                sums[p, e] = (len(mine), mine.sum(axis=0).astype(object))
        books = books.moved(sums)
    assert scanned[0] == 6000 and scanned[-1] < 3000
    steps = np.stack([np.sqrt(((b - a) ** 2).sum(axis=2)) for a, b in itertools.pairwise(books.history)])
    assert (books.drift()[0].max(axis=1) <= steps.sum(axis=0).max(axis=1) + 1e-9).all()

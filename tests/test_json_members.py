"""JSON objects read by byte ranges, against Python's own parser."""

import json
import random

import pytest

from buildgraph.sources import json_members as jm
from buildgraph.sources import readers as rd


def document(rng, n):
    """A document whose strings hold everything that looks like structure."""
    odd = ['"', "\\", "\\\\", '\\"', "{", "}", "[", "]", ",", ":", "é", "漢", "🙂", "\n", " ", "a", '","b":{']

    def text():
        return "".join(rng.choice(odd) for _ in range(rng.randrange(12)))

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 5:
            return {text(): value(depth - 1) for _ in range(rng.randrange(4))}
        return [text(), rng.random(), None, rng.randrange(-5, 10**12)][kind]

    return {f"{i}{text()}": value(3) for i in range(n)}


def members(raw, path, split, chunk, monkeypatch):
    """(rows, bad) by ranges of ``split`` bytes, as the data source reads them."""
    monkeypatch.setattr(jm, "CHUNK_BYTES", chunk)
    path.write_bytes(raw)
    size = len(raw)
    rows = []
    for at in range(0, max(size, 1), split):
        length = min(split, size - at)
        escapes, flips, deeper, seen = jm.summary(jm.chunks_of(str(path), at, at + length))
        rows.append({"file": str(path), "start": at, "length": length, "size": size, "escapes": escapes, "flips": flips, "deeper": deeper, "seen": seen})
    monkeypatch.setattr(jm, "stored_rows", lambda _: rows)
    found = []
    for part in jm.MemberReader({"ranges": ""}).partitions():
        for batch in jm.MemberReader({"ranges": ""}).read(part):
            found += batch.to_pylist()
    return [r for r in found if not r["bad"]], any(r["bad"] for r in found)


@pytest.mark.parametrize("seed", range(6))
def test_every_split_gives_every_member(seed, tmp_path, monkeypatch):
    rng = random.Random(seed)
    doc = document(rng, 12)
    raw = json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5).encode()
    for split, chunk in [(1, 7), (2, 1), (3, 1000), (17, 5), (64, 64), (10_000, 10_000)]:
        rows, bad = members(raw, tmp_path / "d", split, chunk, monkeypatch)
        assert not bad
        assert [(r["key"], json.loads(r["value"])) for r in sorted(rows, key=lambda r: r["at"])] == list(doc.items())


def test_broken_documents_are_found_at_every_split(tmp_path, monkeypatch):
    broken = ["", " ", "{", "}", "[]", "1", '{"a":1', '{"a":1}}', '{"a":1}{"b":2}', '{"a":1} x', 'x {"a":1}', '{"a":1,}', '{,"a":1}', '{"a" 1}']
    broken += ['{"a":1,,"b":2}', '{"a":[1}', '{"a":[1},"b":2]}', '{"a":1]', '{a:1}', '{"a":NaN}', '{"a":"\\x"}', '{"a":"1}', '{"a":1}]', '["a"]{}', '{"a":"\n"}']
    good = ["{}", " { } ", '{"a":{}}', '{"a":[]}\n', '{"":""}', '{"\\\\":"\\\\\\"}"}', '{"a":1,"a":2}']
    for text in broken + good:
        for split, chunk in [(1, 1), (2, 3), (3, 2), (1000, 1000)]:
            rows, bad = members(text.encode(), tmp_path / "d", split, chunk, monkeypatch)
            assert bad == (text in broken), (text, split)
            if not bad:
                assert dict(sorted((r["key"], json.loads(r["value"])) for r in sorted(rows, key=lambda r: r["at"]))) == json.loads(text)
    rows, bad = members(b'{"a":"\xff"}', tmp_path / "d", 4, 4, monkeypatch)
    assert bad


def test_one_document_is_read_by_many_tasks(spark, tmp_path):
    target = {"drvPath": '/d/"{x},\\', "attrPath": ["a", "b}"], "system": "x", "outputs": {"out": "/o,{"}}
    doc = {f'pkgs/{{"{i}"}},\\': target for i in range(300)}
    text = json.dumps(doc)
    # Of a repeated key the last counts, also in another range.
    (tmp_path / "head.json").write_text(text[:-1] + ', "again": {"drvPath": "1"}' + ", \"x\": {}" * 50 + ', "again": {"drvPath": "2"}}')
    (tmp_path / "tiny.json").write_text('{"only": {"system": "y"}}')
    (tmp_path / "none.json").write_text("{}")
    source = jm.read_members(spark, str(tmp_path), split_bytes=500)
    assert source.rdd.getNumPartitions() > 50
    rows = rd.read_snapshots(spark, str(tmp_path), split_bytes=500).collect()
    assert rows == rd.read_snapshots(spark, str(tmp_path)).collect() or sorted(map(repr, rows)) == sorted(
        map(repr, rd.read_snapshots(spark, str(tmp_path)).collect())
    )
    assert {r.tree_path for r in rows if r.snapshot_id == "head"} == set(doc) | {"again", "x"}
    assert [r.drv_path for r in rows if r.tree_path == "again"] == ["2"]
    assert all(r.drv_path == target["drvPath"] and r.outputs == target["outputs"] for r in rows if r.tree_path.startswith("pkgs"))
    (tmp_path / "bad.json").write_text(text[:-1])
    with pytest.raises(Exception, match="malformed document"):
        rd.read_snapshots(spark, str(tmp_path), split_bytes=500).collect()
    assert rd.read_snapshots(spark, str(tmp_path), "quarantine", split_bytes=500).count() == len(rows)
    bad = rd.read_snapshots(spark, str(tmp_path), "quarantine", True, split_bytes=500).collect()
    assert [r.file.rsplit("/", 1)[1] for r in bad] == ["bad.json"]


def test_small_documents_share_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"s{i}.json").write_text(json.dumps({f"a{i}": {"system": "x"}, "b": {"system": f"y{i}"}}))
    (tmp_path / "none.json").write_text("{}")
    (tmp_path / "bad.json").write_text('{"a": {}')
    assert jm.read_members(spark, str(tmp_path)).rdd.getNumPartitions() < 10
    got = sorted(tuple(r) for r in rd.read_snapshots(spark, str(tmp_path), "quarantine").select("snapshot_id", "tree_path", "system").collect())
    assert got == sorted(row for i in range(300) for row in ((f"s{i}", f"a{i}", "x"), (f"s{i}", "b", f"y{i}")))
    bad = rd.read_snapshots(spark, str(tmp_path), "quarantine", True).collect()
    assert [r.file.rsplit("/", 1)[1] for r in bad] == ["bad.json"]

"""Blocks are written and read by columns: what they hold, and that no object costs calls of its own."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tramline.sources import pbf


def rows_of(data: bytes) -> list[dict]:
    found = [r for b in pbf.Block(memoryview(data)).tables(pbf.KINDS) for r in b.to_pylist()]
    return sorted(found, key=lambda r: (pbf.KINDS.index(r["kind"]), r["id"]))


def test_blocks_come_back():
    rng = random.Random(3)
    text = lambda: rng.choice(["", "a", "ö" * 100, "rail", "x" * 300])
    tags = lambda: [(f"k{i}", text()) for i in range(rng.choice([0, 0, 1, 3]))]
    number = lambda: rng.choice([0, 1, -1, 127, 128, 1 << 20, 1 << 40])
    none = {"lon": None, "lat": None, "refs": None, "members": None}
    rows = [{**none, "kind": "node", "id": i * 3 - 50, "tags": tags(), "lon": rng.randint(-1800, 1800) / 10, "lat": rng.randint(-900, 900) / 10} for i in range(60)]
    rows += [{**none, "kind": "way", "id": i * 1000, "tags": tags(), "refs": [number() for _ in range(rng.choice([0, 1, 5, 200]))]} for i in range(60)]
    rows += [{**none, "kind": "relation", "id": i, "tags": tags(), "members": [{"kind": rng.choice(pbf.KINDS), "ref": number(), "role": text()} for _ in range(rng.choice([0, 2]))]} for i in range(20)]
    table = pa.Table.from_pylist(rng.sample(rows, len(rows)), pbf.ARROW)
    got = rows_of(pbf.block(table))
    assert [{**r, "lon": r["lon"] and round(r["lon"], 7), "lat": r["lat"] and round(r["lat"], 7)} for r in got] == rows
    assert rows_of(pbf.block(table.slice(5, 7))) == [r for r in got if r["id"] in table.slice(5, 7)["id"].to_pylist() and any(x["kind"] == r["kind"] and x["id"] == r["id"] for x in table.slice(5, 7).to_pylist())]


def test_references_need_an_id():
    row = {"kind": "way", "id": 1, "tags": [], "lon": None, "lat": None, "refs": [1, None], "members": None}
    with pytest.raises(ValueError):
        pbf.block(pa.Table.from_pylist([row], pbf.ARROW))


def test_fields_of_many_messages():
    messages = [pbf.field(1, 300) + pbf.field(2, b"abc"), b"", pbf.field(2, b"") + pbf.field(1, 7) + pbf.field(1, 1 << 50)]
    b, sizes = np.frombuffer(b"".join(messages), np.uint8), np.array([len(m) for m in messages])
    end = np.cumsum(sizes)
    found = pbf.fields_of(b, end - sizes, end)
    assert found[1][0].tolist() == [300, 0, 1 << 50] and found[2][2].tolist() == [3, 0, 0]
    with pytest.raises(ValueError):
        pbf.fields_of(b, np.array([0]), np.array([4]))


def test_calls_do_not_grow_with_the_ways(monkeypatch):
    row = {"tags": [("railway", "rail")], "lon": None, "lat": None, "members": None, "kind": "way"}
    calls, own = [], np.cumsum
    monkeypatch.setattr(pbf.np, "cumsum", lambda *a, **k: calls.append(1) or own(*a, **k))
    counts = []
    for n in (10, 1000):
        calls.clear()
        rows_of(pbf.block(pa.Table.from_pylist([{**row, "id": i, "refs": [i, i + 1]} for i in range(n)], pbf.ARROW)))
        counts.append(len(calls))
    assert counts[0] == counts[1]

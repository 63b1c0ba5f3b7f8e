"""Map extracts: the format byte by byte, the source, ways put together, and filters; brute force beside each."""

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tramline.sources import osm, pbf


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def zig(n):
    return varint(n << 1 if n >= 0 else (-n << 1) - 1)


def sized(number, body):
    return varint(number << 3 | 2) + varint(len(body)) + body


def frame(kind, content, pack=True):
    body = varint(2 << 3) + varint(len(content)) + sized(3, zlib.compress(content)) if pack else sized(1, content)
    head = sized(1, kind) + sized(2, b"index") + varint(3 << 3) + varint(len(body))
    return struct.pack(">I", len(head)) + head + body


def by_hand():
    """A file with a plain node, dense nodes with offsets and a coarser grain, a way and a relation; blobs packed and not."""
    strings = sized(1, b"".join(sized(1, s) for s in (b"", b"name", "Hof Süd".encode(), b"railway", b"rail", b"outer")))
    node = sized(1, varint(1 << 3) + zig(-7) + sized(2, varint(1)) + sized(3, varint(2)) + varint(8 << 3) + zig(530000000) + varint(9 << 3) + zig(-100000000))
    first = strings + sized(2, node)
    dense = sized(1, zig(10) + zig(2) + zig(-5)) + sized(5, b"skip") + sized(8, zig(5) + zig(1) + zig(-2)) + sized(9, zig(1) + zig(1) + zig(1)) + sized(10, varint(0) + varint(1) + varint(2) + varint(3) + varint(4) + varint(0) + varint(0))
    way = varint(1 << 3) + varint(99) + sized(2, varint(3)) + sized(3, varint(4)) + sized(8, zig(10) + zig(2) + zig(-12) + zig(10))
    relation = varint(1 << 3) + varint(5) + sized(8, varint(5) + varint(0)) + sized(9, zig(99) + zig(-92)) + sized(10, varint(1) + varint(0))
    minus = (1 << 64) - 3_000_000_000
    second = strings + sized(2, sized(2, dense)) + sized(2, sized(3, way)) + sized(2, sized(4, relation)) + varint(17 << 3) + varint(1_000_000_000) + varint(19 << 3) + varint(minus) + varint(20 << 3) + varint(2_000_000_000)
    return frame(b"OSMHeader", sized(4, b"OsmSchema-V0.6") + sized(4, b"DenseNodes")) + frame(b"OSMData", first, False) + frame(b"Other", b"x") + frame(b"OSMData", second)


def test_a_file_made_by_hand(spark, tmp_path):
    (tmp_path / "x.osm.pbf").write_bytes(by_hand())
    for size in (1, 1 << 20):
        df = pbf.read_pbf(spark, str(tmp_path / "x.osm.pbf"), partition_bytes=size)
        assert df.rdd.getNumPartitions() == (2 if size == 1 else 1)
        rows = {(r.kind, r.id): r for r in df.collect()}
        assert set(rows) == {("node", -7), ("node", 10), ("node", 12), ("node", 7), ("way", 99), ("relation", 5)}
        near = lambda r: (round(r.lon, 7), round(r.lat, 7))
        assert rows["node", -7].tags == {"name": "Hof Süd"} and near(rows["node", -7]) == (-10.0, 53.0)
        assert [near(rows["node", i]) for i in (10, 12, 7)] == [(3.0, 2.0), (4.0, 3.0), (5.0, 1.0)]
        assert [rows["node", i].tags for i in (10, 12, 7)] == [{}, {"name": "Hof Süd", "railway": "rail"}, {}]
        assert rows["way", 99].refs == [10, 12, 0, 10] and rows["way", 99].tags == {"railway": "rail"} and rows["way", 99].lon is None
        assert [tuple(m) for m in rows["relation", 5].members] == [("way", 99, "outer"), ("node", 7, "")]
    assert {r.kind for r in pbf.read_pbf(spark, str(tmp_path / "x.osm.pbf"), "way").collect()} == {"way"}


def test_damaged_files_are_refused(tmp_path):
    good = by_hand()
    for name, raw in (("cut", good[:-3]), ("noise", b"\xff" * 50), ("headless", frame(b"OSMData", b"")), ("future", frame(b"OSMHeader", sized(4, b"HistoricalInformation")))):
        (tmp_path / f"{name}.pbf").write_bytes(raw)
        with pytest.raises(ValueError):
            pbf.scan(str(tmp_path / f"{name}.pbf"), len(raw))
    with pytest.raises(ValueError):
        pbf.unpack(sized(3, zlib.compress(b"abc")) + varint(2 << 3) + varint(4))
    with pytest.raises(ValueError):
        pbf.unpack(sized(4, b"lzma"))
    with pytest.raises(FileNotFoundError):
        pbf.files_of(str(tmp_path / "none"))


def test_numbers():
    rng = random.Random(1)
    values = [0, 1, 127, 128, 2**63, 2**64 - 1, *(rng.getrandbits(rng.randint(1, 64)) for _ in range(300))]
    raw = b"".join(map(varint, values))
    assert pbf.varints(raw).tolist() == values and pbf.packed_varints(np.array(values, np.uint64)) == raw
    whole = [-(2**63), 2**63 - 1, 0, -1, *(rng.randint(-(2**40), 2**40) for _ in range(100))]
    assert pbf.signed(pbf.zigzag(np.array(whole))).tolist() == whole
    assert pbf.sums_within(np.array([1, 2, 3, 4]), np.array([0, 3, 0, 1, 0])).tolist() == [1, 3, 6, 4]
    assert len(pbf.varints(b"")) == 0
    with pytest.raises(ValueError):
        pbf.varints(b"\x80")


def sample(rng):
    nodes = [("node", i * 3 - 200, {"name": f" Hof {i} "} if i % 4 == 0 else {"shop": ""} if i % 4 == 1 else {}, rng.uniform(-180, 180), rng.uniform(-85, 85), None, None) for i in range(400)]
    ways = [("way", i, {"railway": "rail"} if i % 2 else {"name": "W"} if i % 3 else {}, None, None, [rng.randint(-200, 1300) for _ in range(rng.choice([0, 1, 2, 9]))], None) for i in range(60)]
    relations = [("relation", i, {"type": "route"} if i % 2 else {}, None, None, None, [("way", i, "a"), ("node", -200, ""), ("relation", 3, "b")][: i % 4]) for i in range(12)]
    return nodes + ways + relations


def key(r):
    return (r[0], r[1], sorted(r[2].items()), None if r[3] is None else (round(r[3] * 1e7), round(r[4] * 1e7)), r[5], None if r[6] is None else [tuple(m) for m in r[6]])


def test_written_tables_come_back(spark, tmp_path):
    rows = sample(random.Random(2))
    df = spark.createDataFrame(rows, pbf.SCHEMA).repartition(3)
    path = f"file://{tmp_path}/out"
    pbf.write_pbf(df, path)
    back = sorted(map(key, pbf.read_pbf(spark, path, partition_bytes=1).collect()))
    assert back == sorted(map(key, rows))
    with pytest.raises(Exception, match="FileExists"):
        pbf.write_pbf(df, path)
    pbf.write_pbf(df.where("kind = 'way'"), path, "overwrite")
    assert {r.kind for r in pbf.read_pbf(spark, path).collect()} == {"way"}


def test_a_failed_write_leaves_nothing_to_read(spark, tmp_path):
    bad = spark.createDataFrame([("node", 1, {}, 1.0, 2.0, None, None), ("node", 2, {}, None, None, None, None)], pbf.SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="needs a kind"):
        pbf.write_pbf(bad, str(tmp_path / "bad"))
    assert pbf.files_of(str(tmp_path / "bad")) == []


def test_ways_of_many_missing_and_shared_nodes(spark):
    rng = random.Random(3)
    places = {i: (rng.random(), rng.random()) for i in range(100_000)}
    nodes = spark.createDataFrame(pa.table({"id": list(places), "lon": [p[0] for p in places.values()], "lat": [p[1] for p in places.values()]})).select(F.lit("node").alias("kind"), "id", F.lit(None).cast("map<string,string>").alias("tags"), "lon", "lat", F.lit(None).cast("array<long>").alias("refs"), F.lit(None).cast("array<struct<kind:string,ref:long,role:string>>").alias("members"))
    given = {1: rng.sample(range(100_000), 100_000), 2: [5, 200_000, 6, 5, 300_000], 3: [7, 7, 7], 4: [], 5: [999_999], 6: [5, 6]}
    ways = spark.createDataFrame([("way", i, {"n": str(i)}, None, None, refs, None) for i, refs in given.items()], pbf.SCHEMA)
    for r in osm.way_lines(nodes.unionByName(ways)).collect():
        assert [tuple(p) for p in r.line] == [places[n] for n in given[r.id] if n in places]
        assert r.missing == sum(n not in places for n in given[r.id]) and r.tags == {"n": str(r.id)}


def test_filter_by_tags_keeps_what_is_needed(spark):
    rows = sample(random.Random(4))
    objects = spark.createDataFrame(rows + rows[:50], pbf.SCHEMA)
    got = sorted((r.kind, r.id) for r in osm.matching(objects, F.coalesce(osm.tag_of("railway") == "rail", F.lit(False)) | F.coalesce(osm.tag_of("type") == "route", F.lit(False))).collect())
    wanted = {(r[0], r[1]) for r in rows if r[2].get("railway") == "rail" or r[2].get("type") == "route"}
    wanted |= {(m[0], m[1]) for r in rows if (r[0], r[1]) in wanted and r[6] for m in r[6]}
    wanted |= {("node", n) for r in rows if (r[0], r[1]) in wanted and r[5] for n in r[5]}
    assert got == sorted(wanted & {(r[0], r[1]) for r in rows})


def test_named_objects_and_railways(spark):
    rows = sample(random.Random(5))
    objects = spark.createDataFrame(rows, pbf.SCHEMA)
    at = {r[1]: (r[3], r[4]) for r in rows if r[0] == "node"}
    line = lambda r: [at[n] for n in r[5] if n in at]
    named = sorted((r.osm_type, r.osm_id, r.name, [tuple(p) for p in r.nodes]) for r in osm.named_objects(objects).collect())
    assert named == sorted((r[0], r[1], r[2]["name"].strip(), [at[r[1]]] if r[0] == "node" else line(r)) for r in rows if r[0] != "relation" and "name" in r[2])
    rails = sorted((r.id, [[tuple(p) for p in x] for x in r.parts]) for r in osm.railway_lines(objects).collect())
    assert rails == sorted((r[1], [line(r)]) for r in rows if r[0] == "way" and "railway" in r[2] and len(line(r)) >= 2)

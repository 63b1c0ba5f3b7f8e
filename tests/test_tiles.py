"""Tiles written and read back: points, lines and polygons with holes."""

import random

from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators import mvt

Z, X, Y = 9, 300, 200


def degrees(x, y):
    west, _, east, north = geo.tile_bounds(Z, X, Y)
    unit = (east - west) / geo.EXTENT
    return geo.inverse_mercator(west + x * unit + 1e-4, north - y * unit - 1e-4)


def box(x0, y0, x1, y1):
    return [degrees(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


def area(part):
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(part, part[1:] + part[:1], strict=True)) / 2


def test_polygons_are_clipped_and_turned():
    rings = [(0, box(-500, -500, 1000, 1000)[::-1]), (1, box(100, 100, 200, 200)), (0, box(1500, 1500, 1500.2, 1500.2)), (1, box(1, 1, 500, 500))]
    data = mvt.encode_layer("areas", [(rings, {"name": "a", "n": 3, "ok": True, "half": 0.5, "none": None}), ([(0, box(3000, 3000, 4000, 4000))], {})], Z, X, Y, polygons=True)
    (feature,) = mvt.read_features(data)  # the second lies elsewhere, a ring too small is gone with its hole
    assert feature["kind"] == 3 and dict(feature["properties"]) == {"name": "a", "n": "3", "ok": "true", "half": "0.5"}
    assert [area(p) for p in feature["parts"]] == [1096.0**2, -(100.0**2)]


def test_clipped_rings_cover_what_lies_inside():
    rng = random.Random(1)
    for _ in range(200):
        ring = [(rng.uniform(-50, 150), rng.uniform(-50, 150)) for _ in range(3)]
        own = mvt.clip_ring([*ring, ring[0]], 0.0, 100.0)
        assert all(-1e-9 <= c <= 100 + 1e-9 for p in own for c in p)

        def holds(of, x, y):
            return sum((a[1] > y) != (b[1] > y) and x < (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) + a[0] for a, b in zip(of, of[1:] + of[:1], strict=True)) % 2 == 1

        for _ in range(30):
            x, y = rng.uniform(0, 100), rng.uniform(0, 100)
            assert holds(own, x, y) == holds(ring, x, y)


def test_points_and_lines_come_back(spark):
    at = lambda *p: [degrees(x, y) for x, y in p]
    rows = [(Z, X, Y, at((5, 7)), "p"), (Z, X, Y, at((10, 10), (20, 30), (3000, 30)), "l"), (Z, X, Y, at((9000, 9000)), "far"), (Z, X + 1, Y, at((2048 + 3, 4)), "next"), (Z, X, Y, None, "none")]
    df = spark.createDataFrame(rows, "z int, x int, y int, points array<struct<lon:double,lat:double>>, name string")
    got = {r.properties["name"]: r for r in mvt.features_of(mvt.tiles(df, "things", ["name"])).collect()}
    assert set(got) == {"p", "l", "next"} and {r.layer for r in got.values()} == {"things"}
    parts = lambda n: [[(p.x, p.y) for p in part] for part in got[n].parts]
    assert parts("p") == [[(5, 7)]] and parts("l") == [[(10, 10), (20, 30), (2144, 30)]] and parts("next") == [[(3, 4)]]
    assert (got["next"].x, got["p"].kind, got["l"].kind) == (X + 1, 1, 2)


def test_polygon_tiles_of_a_table(spark):
    rings = [(0, box(0, 0, 100, 100)), (1, box(10, 10, 20, 20))]
    df = spark.createDataFrame([(Z, X, Y, rings, "a")], "z int, x int, y int, points array<struct<nth:int,ring:array<struct<lon:double,lat:double>>>>, name string")
    (row,) = mvt.features_of(mvt.tiles(df, "areas", ["name"], polygons=True)).select("kind", F.size("parts").alias("n")).collect()
    assert (row.kind, row.n) == (3, 2)

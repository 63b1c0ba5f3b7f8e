"""Areas: rings worked out once, holes among several outer rings, points by rings a row each."""

from pyspark.sql import functions as F

from tests.test_tiles import X, Y, Z, area, box
from tramline.functions import geo
from tramline.operators import mvt, poi, polygons

RING = "array<struct<lon:double,lat:double>>"


def test_a_ring_is_worked_out_once(spark):
    for made in (polygons.valid_ring, polygons.signed_area, polygons.from_smallest, lambda r: geo.box_meets(r, (0.0, 0.0, 1.0, 1.0))):
        assert str(made(F.col("given_ring"))).count("given_ring") == 1


def test_holes_stay_with_any_of_the_outer_rings_before_them():
    rings = [(0, box(0, 0, 1000, 1000)), (0, box(1500, 1500, 1500.2, 1500.2)), (1, box(100, 100, 200, 200))]
    (feature,) = mvt.read_features(mvt.encode_layer("areas", [(rings, {"name": "a"})], Z, X, Y, polygons=True))
    assert sorted(area(p) for p in feature["parts"]) == [-(100.0**2), 1000.0**2]


def test_boxes_meet(spark):
    df = spark.createDataFrame([([(1.0, 1.0), (3.0, 1.0), (3.0, 2.0)],), ([(5.0, 5.0)],), ([],)], f"line {RING}")
    got = [r[0] for r in df.select(geo.box_meets(F.col("line"), (2.0, 1.5, 4.0, 4.0))).collect()]
    assert got == [True, False, None]


def test_points_by_rings_a_row_each(spark):
    square = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]
    rings = spark.createDataFrame([("A", square(0.0, 0.0, 6.0)), ("A", square(2.0, 2.0, 2.0)), ("B", square(2.0, 2.0, 2.0))], f"state_code string, ring {RING}")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 9.0, 9.0), (4, 5.5, 0.5)], "id int, lon double, lat double")
    assert {r.id: r.state_code for r in poi.states_of_points(points, rings, 1.0).collect()} == {1: "A", 2: "B", 3: None, 4: "A"}

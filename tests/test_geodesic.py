"""Lengths on the spheroid against published pairs, and against the meridian and the equator in closed form."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.functions import geodesic

#: Published values: longitudes and latitudes in degrees, metres.
PUBLISHED = [
    (144 + 25 / 60 + 29.52440 / 3600, -(37 + 57 / 60 + 3.72030 / 3600), 143 + 55 / 60 + 35.38390 / 3600, -(37 + 39 / 60 + 10.15610 / 3600), 54972.271),
    (-73.8, 40.6, -0.5, 51.6, 5551759.400),
    (0.0, 0.0, 0.0, 90.0, 10001965.729),
    (0.0, 0.0, 180.0, 0.0, 20003931.459),
    (0.0, -30.0, 179.8, 29.9, 19989832.828),
    (0.0, 0.0, 179.5, 0.5, 19936288.579),
    (0.0, 0.0, 179.7, 0.5, 19944127.421),
]


@pytest.mark.parametrize("pair", PUBLISHED)
def test_published_pairs(pair):
    *at, meters = pair
    assert abs(geodesic.inverse_m(*([x] for x in at))[0] - meters) < 1e-3
    a, b, c, d = at
    assert abs(geodesic.inverse_m([c], [d], [a], [b])[0] - meters) < 1e-3


def test_equator_meridian_and_same_place():
    assert geodesic.inverse_m([10.0], [50.0], [10.0], [50.0])[0] == 0
    assert abs(geodesic.inverse_m([-175.0], [0.0], [175.0], [0.0])[0] - math.radians(10) * geodesic.AXIS) < 1e-6
    e2 = geodesic.FLATTENING * (2 - geodesic.FLATTENING)
    x = np.radians(np.linspace(20, 71, 200_001))
    y = geodesic.AXIS * (1 - e2) / (1 - e2 * np.sin(x) ** 2) ** 1.5
    arc = (x[1] - x[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    assert abs(geodesic.inverse_m([3.0], [20.0], [3.0], [71.0])[0] - arc) < 1e-4
    assert abs(geodesic.inverse_m([3.0], [80.0], [-177.0], [70.0])[0] - geodesic.inverse_m([3.0], [80.0], [3.0], [90.0])[0] - geodesic.inverse_m([3.0], [90.0], [3.0], [70.0])[0]) < 1e-4


def test_near_opposite_points_obey_the_triangle():
    rng = random.Random(1)
    for _ in range(6):
        lon, lat = rng.uniform(-180, 180), rng.uniform(-80, 80)
        other = (lon + 180 + rng.uniform(-0.4, 0.4), -lat + rng.uniform(-0.4, 0.4))
        d = geodesic.inverse_m([lon], [lat], [other[0]], [other[1]])[0]
        assert 19.9e6 < d < 20003931.5
        via = [(rng.uniform(-180, 180), rng.uniform(-85, 85)) for _ in range(200)]
        x, y = np.array(via).T
        assert (geodesic.inverse_m(np.full(200, lon), np.full(200, lat), x, y) + geodesic.inverse_m(x, y, np.full(200, other[0]), np.full(200, other[1])) >= d - 1e-3).all()


def test_columns(spark):
    rng = random.Random(2)
    rows = [(i, [(rng.uniform(5, 15), rng.uniform(47, 55)) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 50, 0, 2])] + [(7, None), (8, [(1.0, 2.0), (None, 2.0)])]
    df = spark.createDataFrame(rows, "id int, line array<struct<lon:double,lat:double>>").coalesce(1)
    got = {r.id: r.m for r in df.select("id", geodesic.spheroid_length(F.col("line")).alias("m")).collect()}
    for i, line in rows:
        if line is None or len(line) < 2 or i == 8:
            assert got[i] is None
        else:
            assert abs(got[i] - sum(geodesic.inverse_m([a[0]], [a[1]], [b[0]], [b[1]])[0] for a, b in zip(line, line[1:], strict=False))) < 1e-4
    pair = spark.createDataFrame([(-73.8, 40.6, -0.5, 51.6), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    assert [None if r.m is None else round(r.m, 3) for r in pair.select(geodesic.spheroid_m(*(F.col(c) for c in "abcd")).alias("m")).collect()] == [5551759.4, None]

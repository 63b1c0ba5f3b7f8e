"""Lengths on the spheroid: the inverse geodesic problem over many pairs at a time, as columns.

Longitudes on the auxiliary sphere are iterated for all pairs together until
none moves.  That fails for points nearly opposite each other.  There the way
is split where it crosses the circle a quarter of the sphere away from its
first point: the two parts are short enough for the iteration, and the place on
the circle that makes their sum the least, found by narrowing, lies on the way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Half axis and flattening of WGS 84.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
#: Places tried on the circle at first, and steps of narrowing (each to 0.62 of the width).
PLACES, STEPS = 720, 60


def _iterated(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Metres between places in radians; nan where the iteration does not end."""
    f, b = FLATTENING, AXIS * (1 - FLATTENING)
    u1, u2 = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    apart = np.abs(lon2 - lon1) % (2 * np.pi)
    apart = np.minimum(apart, 2 * np.pi - apart)
    turn = apart.copy()
    ended = np.zeros(len(turn), bool)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(60):
            sin_s = np.hypot(c2 * np.sin(turn), c1 * s2 - s1 * c2 * np.cos(turn))
            cos_s = s1 * s2 + c1 * c2 * np.cos(turn)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, c1 * c2 * np.sin(turn) / sin_s, 0.0)
            cos2_a = 1 - sin_a**2
            cos_2m = np.where(cos2_a > 1e-15, cos_s - 2 * s1 * s2 / cos2_a, 0.0)
            c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
            after = apart + (1 - c) * f * sin_a * (sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
            ended = np.abs(after - turn) < 1e-13
            turn = after
            if ended.all():
                break
        ended &= np.abs(turn) <= np.pi
        k = cos2_a * (AXIS**2 - b**2) / b**2
        big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        less = big_b * sin_s * (cos_2m + big_b / 4 * (cos_s * (2 * cos_2m**2 - 1) - big_b / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)))
    return np.where(ended, b * big_a * (sigma - less), np.where(np.isnan(apart + u1 + u2), np.nan, np.inf))


def _by_way_of(lon1: float, lat1: float, lon2: float, lat2: float, bearing: np.ndarray) -> np.ndarray:
    """Metres from one place to another by way of places a quarter of the sphere away from the first, in the directions given."""
    lat = np.arcsin(np.clip(np.cos(lat1) * np.cos(bearing), -1, 1))
    lon = lon1 + np.arctan2(np.sin(bearing) * np.cos(lat1), -np.sin(lat1) * np.sin(lat))
    whole = np.full(len(bearing), 1.0)
    return _iterated(lon1 * whole, lat1 * whole, lon, lat) + _iterated(lon, lat, lon2 * whole, lat2 * whole)


def _split(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """Metres between two places nearly opposite each other."""
    tried = np.arange(PLACES) * (2 * np.pi / PLACES)
    values = _by_way_of(lon1, lat1, lon2, lat2, tried)
    gold, width, best = (np.sqrt(5) - 1) / 2, 2 * np.pi / PLACES, np.inf
    for at in tried[np.argsort(values)[:4]].tolist():
        low, high = at - width, at + width
        for _ in range(STEPS):
            a, b = high - gold * (high - low), low + gold * (high - low)
            x, y = _by_way_of(lon1, lat1, lon2, lat2, np.array([a, b]))
            low, high = (low, b) if x <= y else (a, high)
            best = min(best, x, y)
    return float(best)


def inverse_m(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Metres between places in degrees, nan where a coordinate is; right to a tenth of a millimetre, for opposite points too."""
    at = [np.radians(np.asarray(x, float)) for x in (lon1, lat1, lon2, lat2)]
    out = _iterated(*at)
    for i in np.flatnonzero(np.isinf(out)).tolist():
        out[i] = _split(*(float(x[i]) for x in at))
    return out


@F.pandas_udf(DoubleType())
def _pairs(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    return pd.Series(inverse_m(lon1, lat1, lon2, lat2)).astype(object).where(lambda s: s.notna(), None)


@F.pandas_udf(DoubleType())
def _lines(lons: pd.Series, lats: pd.Series) -> pd.Series:
    sizes = np.fromiter((0 if x is None else len(x) for x in lons), np.int64, len(lons))
    out = np.full(len(sizes), None, object)
    if not sizes.sum():
        return pd.Series(out)
    x, y = (np.concatenate([np.asarray(v, float) for v in c if v is not None and len(v)]) for c in (lons, lats))
    steps = np.append(inverse_m(x[:-1], y[:-1], x[1:], y[1:]), 0.0)
    end = np.cumsum(sizes)
    steps[end[sizes > 0] - 1] = 0.0  # from one line to the next
    filled = np.flatnonzero(sizes >= 2)
    sums = np.add.reduceat(steps, (end - sizes)[sizes > 0])
    where = np.cumsum(sizes > 0) - 1
    out[filled] = sums[where[filled]]
    return pd.Series([None if v is None or v != v else v for v in out])


def spheroid_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two places on the spheroid; null if a coordinate is."""
    return _pairs(*(c.cast("double") for c in (lon1, lat1, lon2, lat2)))


def spheroid_length(line: Column) -> Column:
    """Length in metres of a line of points (lon, lat) on the spheroid; null below two points."""
    return _lines(F.transform(line, lambda p: p["lon"]), F.transform(line, lambda p: p["lat"]))

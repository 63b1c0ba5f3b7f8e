"""Geometry on longitudes and latitudes as Column functions; lines are arrays of (lon, lat)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean earth radius, the sphere of Web Mercator, and half the width of its map, in metres.
EARTH_M = 6371008.8
MERCATOR_M = 6378137.0
HALF_MAP = 20037508.342789244
EXTENT, BUFFER = 2048, 96


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once: a column that is written several times in an expression is else evaluated as often, and inside a lambda for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def flat_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance on a local plane, good for short ways."""
    dx = (lon2 - lon1) * 111320.0 * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(dx, (lat2 - lat1) * 111320.0)


def line_length(line: Column) -> Column:
    """Length in metres of a line; null below two points."""
    inner = F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(1)))
    steps = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(1))), inner, lambda a, b: haversine_m(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.when(F.size(line) >= 2, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * MERCATOR_M, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_M


def inverse_mercator(x: float, y: float) -> tuple[float, float]:
    return math.degrees(x / MERCATOR_M), math.degrees(2 * math.atan(math.exp(y / MERCATOR_M)) - math.pi / 2)


def tile_bounds(z: int, x: int, y: int, buffer: float = 0.0) -> tuple[float, float, float, float]:
    """(west, south, east, north) of a tile in Mercator metres, widened by a share of its width."""
    size = 2 * HALF_MAP / 2**z
    west, north = -HALF_MAP + x * size, HALF_MAP - y * size
    m = buffer * size
    return west - m, north - size - m, west + size + m, north + m


def tile_envelope(z: Column, x: Column, y: Column, buffer: float = 0.0) -> Column:
    """west, south, east, north of tiles held in columns, as tile_bounds gives them."""
    size = 2 * HALF_MAP / F.pow(F.lit(2.0), z)
    west, north, m = x * size - HALF_MAP, HALF_MAP - y * size, size * buffer
    return F.struct((west - m).alias("west"), (north - size - m).alias("south"), (west + size + m).alias("east"), (north + m).alias("north"))


def tile_degrees(z: int, x: int, y: int, buffer: float = BUFFER / EXTENT) -> tuple[float, float, float, float]:
    w, s, e, n = tile_bounds(z, x, y, buffer)
    return (*inverse_mercator(w, s), *inverse_mercator(e, n))


def tile_of(lon: Column, lat: Column, z: int | Column) -> tuple[Column, Column]:
    """Column and row of the tile that holds a point."""
    mx, my = mercator(lon, lat)
    size = 2 * HALF_MAP / 2**z if isinstance(z, int) else 2 * HALF_MAP / F.pow(F.lit(2.0), z)
    return F.floor((mx + HALF_MAP) / size).cast("int"), F.floor((F.lit(HALF_MAP) - my) / size).cast("int")


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def box_meets(line: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether the box around a line or ring and another box have a point in common."""
    side = lambda of, points, c: of(F.transform(points, lambda p: p[c]))
    meets = lambda points: (side(F.array_max, points, "lon") >= box[0]) & (side(F.array_min, points, "lon") <= box[2]) & (side(F.array_max, points, "lat") >= box[1]) & (side(F.array_min, points, "lat") <= box[3])
    return bound(line, meets)


def in_polygon(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test against one ring of fixed corners, as a sum of crossings; the bounding box is tested first."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            hit = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1)
            crossings = crossings + hit.cast("int")
    return in_box(lon, lat, (min(xs), min(ys), max(xs), max(ys))) & (crossings % 2 == 1)


def ring_contains(lon: Column, lat: Column, ring: Column) -> Column:
    """The same against a ring held in a column."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(1))), F.slice(ring, 1, 1))
    hit = F.zip_with(ring, following, lambda a, b: ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (lat - a["lat"]) * (b["lon"] - a["lon"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]))
    return F.aggregate(hit, F.lit(0), lambda s, h: s + F.coalesce(h, F.lit(False)).cast("int")) % 2 == 1


def circle(lon: Column, lat: Column, radius_m: Column, points: int = 32, earth: float = 6371000.0) -> Column:
    """A closed ring of points at one great-circle distance from a centre."""
    d, la, lo = radius_m / earth, F.radians(lat), F.radians(lon)

    def at(i: Column) -> Column:
        b = i * (2 * math.pi / points)
        y = F.asin(F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(b))
        x = lo + F.atan2(F.sin(b) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(y))
        return F.struct(F.degrees(x).alias("lon"), F.degrees(y).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(points)), at)


def cell(lon: Column, lat: Column, size: float) -> tuple[Column, Column]:
    return F.floor(lon / size).cast("long"), F.floor(lat / size).cast("long")


def geojson_line(line: Column) -> Column:
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")))


def ring_area_m2(ring: Column) -> Column:
    """Area of a ring on the sphere, without sign, by the trapezoids under its steps."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(1))), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, following, lambda a, b: F.radians(b["lon"] - a["lon"]) * (2 + F.sin(F.radians(a["lat"])) + F.sin(F.radians(b["lat"]))))
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)) * (EARTH_M**2 / 2)


def geometry_kind(lines: Column) -> Column:
    """What a list of lines is as a geometry: empty, one line or several."""
    filled = F.size(F.filter(lines, lambda x: F.size(x) >= 2))
    return F.when(filled == 0, "EMPTY").when(filled == 1, "LINESTRING").otherwise("MULTILINESTRING")


def residential_circles(stops: DataFrame, minutes: float) -> DataFrame:
    """public_id, ring: circles of 750 m a minute around distinct visible stops of regional or city trains."""
    shown = stops.where(F.col("stop_priority").isin("regional", "urban_rail") & F.col("visible")).dropDuplicates(["public_id"])
    return shown.select("public_id", circle(F.col("lon"), F.col("lat"), F.lit(minutes * 0.75 * 1000)).alias("ring"))

"""Feature layers of GeoPackage files as a Spark data source, ``format("geopackage")``.

A GeoPackage is an SQLite file whose geometries are binary: a header with the
reference system and perhaps an envelope, then well-known binary in either
byte order.  Planning reads the layer's lowest and highest row number; ranges
of them are the partitions.  Places are given in degrees: geographic systems
are taken as they are, UTM zones and Web Mercator are turned back.
"""

from __future__ import annotations

import contextlib
import math
import sqlite3
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tramline.sources.pbf import place

SCHEMA = "fid long, properties map<string,string>, kind string, parts array<struct<part:int,nth:int,points:array<struct<lon:double,lat:double>>>>"
POINTS = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
ARROW = pa.schema([("fid", pa.int64()), ("properties", pa.map_(pa.string(), pa.string())), ("kind", pa.string()), ("parts", pa.list_(pa.struct([("part", pa.int32()), ("nth", pa.int32()), ("points", POINTS)])))])
#: Fixed values of the format: kinds of geometry by number, bytes of an envelope by its code.
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
ENVELOPES = (0, 32, 48, 48, 64)
#: Rows in a partition, and in a batch.
ROWS, BATCH = 5000, 500
#: Half axis and flattening of the ellipsoids of UTM systems, by the number before their zone; geographic systems in degrees.
UTM = {258: (6378137.0, 1 / 298.257222101), 326: (6378137.0, 1 / 298.257223563), 327: (6378137.0, 1 / 298.257223563)}
DEGREES = (4326, 4258, 4269)
MERCATOR, MERCATOR_M = 3857, 6378137.0


# --- binary geometry -------------------------------------------------------------


def geometry(raw: bytes) -> tuple[int, str | None, list[tuple[int, int, np.ndarray]]]:
    """(reference system, kind, parts) of a binary geometry; parts are (part, nth, points of two columns), none if it is empty."""
    if raw[:2] != b"GP" or len(raw) < 8:
        raise ValueError("no GeoPackage geometry")
    flags = raw[3]
    order, envelope = "<" if flags & 1 else ">", flags >> 1 & 7
    if envelope >= len(ENVELOPES) or flags & 32:
        raise ValueError("an envelope or kind of geometry that is not known")
    (system,) = struct.unpack_from(f"{order}i", raw, 4)
    at = 8 + ENVELOPES[envelope]
    kind, parts, end = well_known(raw, at)
    if end != len(raw):
        raise ValueError("a geometry is followed by something else")
    return system, kind, [] if flags & 16 else parts


def well_known(raw: bytes, at: int) -> tuple[str, list[tuple[int, int, np.ndarray]], int]:
    """(kind, parts, end) of the well-known binary that begins at a byte; heights and measures are read over."""
    order = "<" if raw[at] else ">"
    (code,) = struct.unpack_from(f"{order}I", raw, at + 1)
    at += 5
    marks, code = code >> 30, code & 0x3FFFFFFF  # height and measure by the upper bits or by thousands
    dims, code = 2 + (marks.bit_count() or (0, 1, 1, 2)[code // 1000 % 4]), code % 1000
    if code not in KINDS:
        raise ValueError(f"geometry of kind {code}")
    parts: list[tuple[int, int, np.ndarray]] = []

    def number() -> int:
        nonlocal at
        (n,) = struct.unpack_from(f"{order}I", raw, at)
        at += 4
        return n

    def points(n: int) -> np.ndarray:
        nonlocal at
        size = 8 * dims * n
        if at + size > len(raw):
            raise ValueError("a geometry is cut off")
        out = np.frombuffer(raw, f"{order}f8", dims * n, at).reshape(n, dims)[:, :2].astype(np.float64)
        at += size
        return out

    if code == 1:
        if not np.isnan(p := points(1)).any():
            parts = [(0, 0, p)]
    elif code == 2:
        parts = [(0, 0, points(number()))]
    elif code == 3:
        parts = [(0, i, points(number())) for i in range(number())]
    else:
        for i in range(number()):
            _, own, at = well_known(raw, at)
            parts += [(i, nth, p) for _, nth, p in own]
    return KINDS[code], [x for x in parts if len(x[2])], at


# --- reference systems -----------------------------------------------------------


def utm_degrees(xy: np.ndarray, zone: int, south: bool, axis: float, flattening: float) -> np.ndarray:
    """Longitudes and latitudes of UTM places, by the series of the inverse transverse Mercator projection to the sixth power of n."""
    n = flattening / (2 - flattening)
    radius = axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
        4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
        20648693 * n**6 / 638668800,
    )
    z = ((xy[:, 1] - (1e7 if south else 0.0)) + 1j * (xy[:, 0] - 500000.0)) / (0.9996 * radius)
    w = z - sum(b * np.sin(2 * (j + 1) * z) for j, b in enumerate(beta))
    xi, eta = w.real, w.imag
    tau1 = np.sin(xi) / np.hypot(np.sinh(eta), np.cos(xi))  # tangent of the conformal latitude
    e = math.sqrt(flattening * (2 - flattening))
    tau = tau1.copy()
    for _ in range(5):  # Newton's method on the tangent of the latitude
        sigma = np.sinh(e * np.arctanh(e * tau / np.hypot(1, tau)))
        now = tau * np.hypot(1, sigma) - sigma * np.hypot(1, tau)
        tau += (tau1 - now) / np.hypot(1, now) * (1 + (1 - e * e) * tau**2) / ((1 - e * e) * np.hypot(1, tau))
    lon = np.degrees(np.arctan2(np.sinh(eta), np.cos(xi))) + zone * 6 - 183
    return np.stack([lon, np.degrees(np.arctan(tau))], 1)


def degrees_of(xy: np.ndarray, code: int) -> np.ndarray:
    """Longitudes and latitudes of places of a reference system by its EPSG number."""
    if code in DEGREES:
        return xy
    if code == MERCATOR:
        return np.stack([np.degrees(xy[:, 0] / MERCATOR_M), np.degrees(np.arctan(np.sinh(xy[:, 1] / MERCATOR_M)))], 1)
    family, zone = divmod(code, 100)
    if family in UTM and 1 <= zone <= 60:
        return utm_degrees(xy, zone, family == 327, *UTM[family])
    raise ValueError(f"no way from reference system {code} to degrees")


# --- the source ------------------------------------------------------------------


def connect(path: str) -> contextlib.closing:
    """A read-only connection to a file of any file system."""
    system, inner = place(path)
    if isinstance(system, fs.LocalFileSystem):
        return contextlib.closing(sqlite3.connect(f"file:{inner}?mode=ro&immutable=1", uri=True))
    db = sqlite3.connect(":memory:")
    with system.open_input_file(inner) as f:
        db.deserialize(f.read())
    return contextlib.closing(db)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def layers(path: str) -> list[tuple[str, str]]:
    """(name, type) of the layers of a file."""
    with connect(path) as db:
        return db.execute("SELECT table_name, data_type FROM gpkg_contents ORDER BY rowid").fetchall()


@dataclass
class Rows(InputPartition):
    layer: str
    column: str
    systems: dict[int, int]
    first: int
    last: int


class GeoPackageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows, self.layer = options["path"], int(options.get("rows", ROWS)), options.get("layer")

    def partitions(self) -> list[Rows]:
        layer = self.layer or next((n for n, kind in layers(self.path) if kind == "features"), None)
        if not layer:
            raise ValueError(f"{self.path} has no layer of features")
        with connect(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(layer)}").fetchone()
            column = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", [layer]).fetchone()
            systems = {i: code if (organization or "").upper() == "EPSG" else i for i, organization, code in db.execute("SELECT srs_id, organization, organization_coordsys_id FROM gpkg_spatial_ref_sys")}
        if column is None:
            raise ValueError(f"{layer} has no geometry")
        if low is None:
            low, high = 0, -1
        return [Rows(layer, column[0], systems, a, min(high, a + self.rows - 1)) for a in range(low, max(high, low) + 1, self.rows)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with connect(self.path) as db:
            found = db.execute(f"SELECT rowid, * FROM {quoted(partition.layer)} WHERE rowid BETWEEN ? AND ?", [partition.first, partition.last])
            names = [c[0] for c in found.description][1:]
            while rows := found.fetchmany(BATCH):
                yield pa.RecordBatch.from_pylist([feature(partition, r[0], dict(zip(names, r[1:], strict=True))) for r in rows], ARROW)


def feature(of: Rows, fid: int, values: dict) -> dict:
    raw = values.pop(of.column)
    system, kind, parts = geometry(raw) if raw is not None else (0, None, [])
    code = of.systems.get(system, system)
    shaped = [{"part": part, "nth": nth, "points": [{"lon": x, "lat": y} for x, y in degrees_of(p, code).tolist()]} for part, nth, p in parts]
    properties = [(k, None if v is None else str(v)) for k, v in values.items() if not isinstance(v, bytes)]
    return {"fid": fid, "properties": properties, "kind": kind, "parts": shaped}


class GeoPackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GeoPackageReader:
        return GeoPackageReader(self.options)


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None, rows: int = ROWS) -> DataFrame:
    """SCHEMA: the features of a layer; without a name, of the first one."""
    spark.dataSource.register(GeoPackageSource)
    reader = spark.read.format("geopackage").option("rows", str(rows))
    return (reader.option("layer", layer) if layer else reader).load(path)

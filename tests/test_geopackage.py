"""GeoPackage layers: binary geometry by hand, reference systems by other formulas, boundaries with holes."""

import json
import math
import sqlite3
import struct

import numpy as np
import pytest

from tramline.operators import poi
from tramline.sources import geopackage, registry


def wkb(order, code, parts, dims=2, base=0):
    """Well-known binary of a polygon (rings), or of several (polygons), made number by number."""
    out = struct.pack(f"{order}BI", order == "<", code + base)
    if code == 6:
        return out + struct.pack(f"{order}I", len(parts)) + b"".join(wkb(order, 3, p, dims, base) for p in parts)
    out += struct.pack(f"{order}I", len(parts))
    for ring in parts:
        out += struct.pack(f"{order}I", len(ring)) + b"".join(struct.pack(f"{order}{dims}d", *p, *([7.0] * (dims - 2))) for p in ring)
    return out


def packed(order, system, body, envelope=0, empty=False):
    flags = (order == "<") | envelope << 1 | empty << 4
    return b"GP\0" + bytes([flags]) + struct.pack(f"{order}i", system) + bytes((0, 32, 48, 48, 64)[envelope]) + body


def square(a, b):
    return [(a, a), (b, a), (b, b), (a, b), (a, a)]


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize(("dims", "base"), [(2, 0), (3, 1000), (3, 2000), (4, 3000), (3, 0x80000000), (4, 0xC0000000)])
def test_geometry(order, dims, base):
    polygons = [[square(0.0, 9.0), square(3.0, 6.0)], [square(20.0, 21.0)]]
    for envelope in range(5):
        system, kind, parts = geopackage.geometry(packed(order, 25832, wkb(order, 6, polygons, dims, base), envelope))
        assert (system, kind) == (25832, "MultiPolygon")
        assert [(p, n, [tuple(x) for x in xy.tolist()]) for p, n, xy in parts] == [(0, 0, square(0.0, 9.0)), (0, 1, square(3.0, 6.0)), (1, 0, square(20.0, 21.0))]


def test_points_lines_and_mixed_orders():
    point = struct.pack("<BIdd", 1, 1, 9.5, 53.25)
    line = struct.pack(">BII4d", 0, 2, 2, 1, 2, 3, 4)
    _, kind, parts = geopackage.geometry(packed("<", 4326, struct.pack("<BII", 1, 7, 2) + point + line))
    assert kind == "GeometryCollection" and [(p, n, xy.tolist()) for p, n, xy in parts] == [(0, 0, [[9.5, 53.25]]), (1, 0, [[1.0, 2.0], [3.0, 4.0]])]
    nothing = struct.pack("<BIdd", 1, 1, math.nan, math.nan)
    assert geopackage.geometry(packed("<", 0, nothing, empty=True))[2] == [] == geopackage.geometry(packed("<", 0, nothing))[2]


def test_damaged_geometry_is_refused():
    good = packed("<", 4326, wkb("<", 3, [square(0.0, 1.0)]))
    for bad in (b"", b"XX" + good[2:], good[:-1], good + b"\0", packed("<", 4326, struct.pack("<BI", 1, 17))):
        with pytest.raises((ValueError, struct.error)):
            geopackage.geometry(bad)


def utm_by_other_series(lon, lat, zone, axis, f):
    """UTM places by the older series in powers of the longitude's difference, good to a millimetre near the middle of a zone."""
    e2 = f * (2 - f)
    phi, l = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    steps = 200_000  # meridian arc by Simpson's rule
    h = phi / steps
    m = lambda x: axis * (1 - e2) / (1 - e2 * math.sin(x) ** 2) ** 1.5
    xs = np.arange(steps + 1) * h
    values = axis * (1 - e2) / (1 - e2 * np.sin(xs) ** 2) ** 1.5
    arc = h / 3 * (values[0] + values[-1] + 4 * values[1:-1:2].sum() + 2 * values[2:-1:2].sum())
    v = axis / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    psi, t, c, s = v / m(phi), math.tan(phi), math.cos(phi), math.sin(phi)
    east = v * l * c * (1 + l**2 * c**2 / 6 * (psi - t**2) + l**4 * c**4 / 120 * (4 * psi**3 * (1 - 6 * t**2) + psi**2 * (1 + 8 * t**2) - psi * 2 * t**2 + t**4) + l**6 * c**6 / 5040 * (61 - 479 * t**2 + 179 * t**4 - t**6))
    north = arc + v * s * l**2 * c / 2 + v * s * l**4 * c**3 / 24 * (4 * psi**2 + psi - t**2) + v * s * l**6 * c**5 / 720 * (8 * psi**4 * (11 - 24 * t**2) - 28 * psi**3 * (1 - 6 * t**2) + psi**2 * (1 - 32 * t**2) - psi * 2 * t**2 + t**4)
    return 500000 + 0.9996 * east, 0.9996 * north


def test_utm_places():
    for code, zone, family in ((25832, 32, 258), (32633, 33, 326)):
        for lon in (-2.5, -1.0, 0.0, 0.5, 3.0):
            for lat in (0.5, 10.0, 47.3, 53.55, 55.0):
                at = (lon + zone * 6 - 183, lat)
                back = geopackage.degrees_of(np.array([utm_by_other_series(*at, zone, *geopackage.UTM[family])]), code)[0]
                assert abs(back[0] - at[0]) < 2e-8 and abs(back[1] - at[1]) < 2e-8
    pole = geopackage.degrees_of(np.array([[500000.0, 0.9996 * 10001965.7293]]), 25832)[0]
    assert abs(pole[1] - 90) < 1e-8
    assert geopackage.degrees_of(np.array([[500000.0, 1e7]]), 32733)[0].tolist() == [15.0, 0.0]
    assert np.allclose(geopackage.degrees_of(np.array([[20037508.342789244, 0.0]]), 3857), [[180, 0]])
    with pytest.raises(ValueError):
        geopackage.degrees_of(np.zeros((1, 2)), 2056)


#: An outer state with an enclave of another, a neighbour that shares a border, an island.
AREAS = [
    ("Kreis A", "01051", [[square(9.0, 10.0), square(9.4, 9.6)[::-1]]]),
    ("Kreis B", "01052", [[[(10.0, 9.0), (11.0, 9.0), (11.0, 10.0), (10.0, 10.0), (10.0, 9.0)]], [square(13.0, 13.5)]]),
    ("Hamburg", None, [[square(9.4, 9.6)]]),
    ("Bayern", "09", [[square(12.0, 12.5)]]),
]


def write_layer(path, areas, system=4326, order="<", name="vg250_lan"):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT)")
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES ('x', 77, 'EPSG', ?, '')", [system])
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT, identifier TEXT, srs_id INTEGER)")
        db.execute("INSERT INTO gpkg_contents VALUES ('notes', 'attributes', 'n', 0), (?, 'features', 'x', 77)", [name])
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INT, m INT)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'MULTIPOLYGON', 77, 0, 0)", [name])
        db.execute(f"CREATE TABLE {name} (fid INTEGER PRIMARY KEY, geom BLOB, GEN TEXT, AGS TEXT, size REAL)")
        for gen, ags, polygons in areas:
            db.execute(f"INSERT INTO {name} (geom, GEN, AGS, size) VALUES (?, ?, ?, 1.5)", [packed(order, 77, wkb(order, 6, polygons)), gen, ags])
        db.execute(f"INSERT INTO {name} (geom, GEN) VALUES (NULL, 'nowhere')")


def geojson(path, areas):
    features = [{"properties": {"GEN": g, "AGS": a}, "geometry": {"type": "MultiPolygon", "coordinates": p}} for g, a, p in areas]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))


def plain(df):
    return sorted((r.name, r.key, r.polygon.part, r.nth, [tuple(p) for p in r.ring]) for r in df.collect() if r.name)


@pytest.mark.parametrize("order", "<>")
def test_layers_equal_their_geojson(spark, tmp_path, order):
    areas = [(g, a or "", p) for g, a, p in AREAS]
    write_layer(tmp_path / "b.gpkg", areas, order=order)
    geojson(tmp_path / "b.geojson", areas)
    key = lambda rows: [(n, k or "", *rest) for n, k, *rest in rows]
    a, b = (registry.boundaries(spark, str(tmp_path / f)).fillna("", ["key"]) for f in ("b.gpkg", "b.geojson"))
    assert key(plain(a)) == key(plain(b)) and len(plain(a)) == 6
    rows = geopackage.read_geopackage(spark, f"file://{tmp_path}/b.gpkg", rows=2)
    assert rows.rdd.getNumPartitions() == 3
    assert sorted((r.fid, r.kind, r.properties["GEN"], r.properties.get("size")) for r in rows.collect())[-2:] == [(4, "MultiPolygon", "Bayern", "1.5"), (5, None, "nowhere", None)]


def test_reprojected_layer(spark, tmp_path):
    flat = [[[utm_by_other_series(x, y, 32, *geopackage.UTM[258]) for x, y in square(9.0, 10.0)]]]
    write_layer(tmp_path / "u.gpkg", [("Hamburg", "02", flat)], 25832)
    (row,) = registry.boundaries(spark, str(tmp_path / "u.gpkg")).collect()
    assert all(abs(p.lon - x) < 1e-7 and abs(p.lat - y) < 1e-7 for p, (x, y) in zip(row.ring, square(9.0, 10.0), strict=True))


def test_a_place_in_a_hole_has_the_enclaves_state(spark, tmp_path):
    write_layer(tmp_path / "b.gpkg", AREAS)
    states = registry.dissolve(registry.boundaries(spark, str(tmp_path / "b.gpkg")))
    found = {r.state_code: r for r in states.collect()}
    assert set(found) == {"DE-SH", "DE-HH"} and (found["DE-SH"].name, found["DE-SH"].official_key) == ("Kreis B", "01051")
    # one outer ring over both areas, the hole, the island: the border between the areas is gone
    assert sorted(len(r) - 1 for r in found["DE-SH"].rings) == [4, 4, 6]
    points = [("west", 9.2, 9.2), ("hole", 9.5, 9.5), ("east", 10.5, 9.5), ("island", 13.2, 13.2), ("south", 12.2, 12.2), ("border", 9.99, 9.5)]
    df = poi.states_of_points(spark.createDataFrame(points, "id string, lon double, lat double"), states)
    assert {r.id: r.state_code for r in df.collect()} == {"west": "DE-SH", "hole": "DE-HH", "east": "DE-SH", "island": "DE-SH", "south": None, "border": "DE-SH"}

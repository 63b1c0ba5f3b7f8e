"""Vector tiles: clipping, simplification and protobuf encoding of a layer, one task's work per tile."""

from __future__ import annotations

import heapq
import math
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.geo import BUFFER, EXTENT, MERCATOR_M, tile_bounds

Point = tuple[float, float]


def simplify(line: list[Point], tolerance: float) -> list[Point]:
    """Points that a line needs to stay within tolerance of itself; its ends always stay."""
    keep = [False] * len(line)
    if line:
        keep[0] = keep[-1] = True
    stack = [(0, len(line) - 1)]
    while stack:
        a, b = stack.pop()
        worst, at = tolerance, -1
        (x1, y1), (x2, y2) = line[a], line[b]
        dx, dy = x2 - x1, y2 - y1
        size = dx * dx + dy * dy
        for i in range(a + 1, b):
            px, py = line[i][0] - x1, line[i][1] - y1
            t = max(0.0, min(1.0, (px * dx + py * dy) / size)) if size else 0.0
            d = math.hypot(px - t * dx, py - t * dy)
            if d > worst:
                worst, at = d, i
        if at >= 0:
            keep[at] = True
            stack += [(a, at), (at, b)]
    return [p for p, k in zip(line, keep, strict=True) if k]


def simplify_apart(line: list[Point], tolerance: float) -> list[Point]:
    """Points that keep a line within tolerance of itself, and apart where it was apart; its ends always stay.

    Points go one by one, that which the line misses least first.  One may go if
    all the points between its neighbours stay within tolerance of the step that
    takes their place, and if no other point left lies in the triangle that the
    step cuts off: a line without crossings cannot cross the step otherwise.
    Points left are found by a grid.  A closed line keeps four points.
    """
    n = len(line)
    if n < 3:
        return list(line)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    left, closed = n, line[0] == line[-1]
    xs, ys = [p[0] for p in line], [p[1] for p in line]
    size = max(max(xs) - min(xs), max(ys) - min(ys)) / max(1.0, math.sqrt(n)) or 1.0
    cell = lambda p: (math.floor(p[0] / size), math.floor(p[1] / size))
    grid: dict[tuple[int, int], set[int]] = {}
    for i, p in enumerate(line):
        grid.setdefault(cell(p), set()).add(i)

    def error(a: int, b: int) -> float:
        (x1, y1), (x2, y2) = line[a], line[b]
        dx, dy = x2 - x1, y2 - y1
        square, worst = dx * dx + dy * dy, 0.0
        for i in range(a + 1, b):
            px, py = line[i][0] - x1, line[i][1] - y1
            t = max(0.0, min(1.0, (px * dx + py * dy) / square)) if square else 0.0
            worst = max(worst, math.hypot(px - t * dx, py - t * dy))
        return worst

    def side(p: Point, q: Point, r: Point) -> float:
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def free(a: int, i: int, b: int) -> bool:
        p, q, r = line[a], line[i], line[b]
        low, high = cell((min(p[0], q[0], r[0]), min(p[1], q[1], r[1]))), cell((max(p[0], q[0], r[0]), max(p[1], q[1], r[1])))
        if (high[0] - low[0] + 1) * (high[1] - low[1] + 1) > len(grid):
            near = (j for of in grid.values() for j in of)
        else:
            near = (j for x in range(low[0], high[0] + 1) for y in range(low[1], high[1] + 1) for j in grid.get((x, y), ()))
        for j in near:
            s = line[j]
            if j in (a, i, b) or s in (p, r):
                continue
            turns = side(p, q, s), side(q, r, s), side(r, p, s)
            if (min(turns) >= 0 or max(turns) <= 0) and min(p[0], q[0], r[0]) <= s[0] <= max(p[0], q[0], r[0]) and min(p[1], q[1], r[1]) <= s[1] <= max(p[1], q[1], r[1]):
                return False
        return True

    heap = [(e, i, i - 1, i + 1) for i in range(1, n - 1) if (e := error(i - 1, i + 1)) <= tolerance]
    heapq.heapify(heap)
    refused: set[int] = set()
    while heap and left > (4 if closed else 2):
        _, i, a, b = heapq.heappop(heap)
        if before[i] != a or after[i] != b or after[a] != i:
            continue  # a neighbour has gone since
        if not free(a, i, b):
            refused.add(i)
            continue
        after[a], before[b] = b, a
        after[i] = before[i] = -1
        grid[cell(line[i])].discard(i)
        left -= 1
        for k in {a, b, *refused}:
            if 0 < k < n - 1 and after[k] >= 0 and (e := error(before[k], after[k])) <= tolerance:
                heapq.heappush(heap, (e, k, before[k], after[k]))
        refused.clear()
    out, i = [], 0
    while i < n:
        out.append(line[i])
        i = after[i]
    return out


def clip(line: list[Point], low: float, high: float) -> list[list[Point]]:
    """The parts of a line inside a square, cut where they cross its edge."""
    out: list[list[Point]] = []
    for (x1, y1), (x2, y2) in zip(line, line[1:], strict=False):
        t0, t1, dx, dy = 0.0, 1.0, x2 - x1, y2 - y1
        for p, q in ((-dx, x1 - low), (dx, high - x1), (-dy, y1 - low), (dy, high - y1)):
            if p == 0:
                if q < 0:
                    t0, t1 = 1.0, 0.0
            elif p < 0:
                t0 = max(t0, q / p)
            else:
                t1 = min(t1, q / p)
        if t0 > t1:
            continue
        # uncut ends stay what they are, so that steps which follow each other make one part
        a, b = (x1 + t0 * dx, y1 + t0 * dy), (x2, y2) if t1 == 1.0 else (x1 + t1 * dx, y1 + t1 * dy)
        if out and t0 == 0.0 and out[-1][-1] == (x1, y1):
            out[-1].append(b)
        else:
            out.append([a, b])
    return out


def clip_ring(ring: list[Point], low: float, high: float) -> list[Point]:
    """The part of a closed ring inside a square, closed along its sides; side by side with the sides taken one after the other."""
    out = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else list(ring)
    for axis, bound, sign in ((0, low, 1), (0, high, -1), (1, low, 1), (1, high, -1)):
        kept: list[Point] = []
        for p, q in zip(out, out[1:] + out[:1], strict=True):
            a, b = sign * (p[axis] - bound), sign * (q[axis] - bound)
            if a >= 0:
                kept.append(p)
            if (a >= 0) != (b >= 0):
                t = a / (a - b)
                cut = [p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])]
                cut[axis] = bound
                kept.append((cut[0], cut[1]))
        out = kept
        if not out:
            return []
    return out


def ring_geometry(rings: list[list[Point]]) -> list[int]:
    """Drawing commands of a polygon's rings, the first the outer one, or of several polygons' if they follow each other so.

    Rings that shrink to nothing are left out, with the holes of an outer one
    that does; outer rings in a row count as one polygon, whose holes stay with
    any of them.  Outer rings have a positive area with y downwards, holes a
    negative one, as readers expect.
    """
    out, cx, cy, outer_there, after_hole = [], 0, 0, False, True
    zig = lambda n: n << 1 ^ n >> 31
    for nth, ring in rings:
        if nth == 0 and after_hole:
            outer_there = False
        after_hole = nth > 0
        cells: list[tuple[int, int]] = []
        for px, py in ring:
            p = (math.floor(px), math.floor(py))
            if not cells or cells[-1] != p:
                cells.append(p)
        if len(cells) > 1 and cells[0] == cells[-1]:
            cells.pop()
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(cells, cells[1:] + cells[:1], strict=True))
        if len(cells) < 3 or not area:
            continue
        if nth == 0:
            outer_there = True
        elif not outer_there:
            continue
        if (area > 0) != (nth == 0):
            cells.reverse()
        for i, (px, py) in enumerate(cells):
            if i == 0:
                out.append(1 << 3 | 1)
            elif i == 1:
                out.append(len(cells) - 1 << 3 | 2)
            out += [zig(px - cx), zig(py - cy)]
            cx, cy = px, py
        out.append(1 << 3 | 7)
    return out


def to_tile(points: list[Point], z: int, x: int, y: int) -> list[Point]:
    """Degrees to units of the tile, y downwards."""
    west, _, east, north = tile_bounds(z, x, y)
    scale = EXTENT / (east - west)
    merc = ((math.radians(lon) * MERCATOR_M, math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * MERCATOR_M) for lon, lat in points)
    return [((mx - west) * scale, (north - my) * scale) for mx, my in merc]


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def _value(v) -> bytes:
    if isinstance(v, bool):
        return varint(7 << 3) + varint(int(v))
    if isinstance(v, int):
        return varint(4 << 3) + varint(v & (1 << 64) - 1)
    if isinstance(v, float):
        return varint(3 << 3 | 1) + struct.pack("<d", v)
    return _field(1, str(v).encode())


def geometry(parts: list[list[Point]], is_point: bool) -> list[int]:
    """Drawing commands with zigzag steps; repeated points are left out."""
    out, cx, cy = [], 0, 0
    zig = lambda n: n << 1 ^ n >> 31
    for part in parts:
        cells: list[tuple[int, int]] = []
        for px, py in part:
            p = (math.floor(px), math.floor(py))
            if not cells or cells[-1] != p:
                cells.append(p)
        if not is_point and len(cells) < 2:
            continue
        for i, (px, py) in enumerate(cells):
            if i == 0:
                out.append(1 << 3 | 1)
            elif i == 1:
                out.append(len(cells) - 1 << 3 | 2)
            out += [zig(px - cx), zig(py - cy)]
            cx, cy = px, py
    return out


def _drawn(points: list[Point], z: int, x: int, y: int, tolerance: float, low: float, high: float) -> tuple[int, list[int]]:
    """(kind, drawing commands) of a point or a line."""
    is_point = len(points) == 1
    own = to_tile(simplify_apart(points, tolerance) if tolerance and not is_point else points, z, x, y)
    parts = ([own] if all(low <= c <= high for c in own[0]) else []) if is_point else clip(own, low, high)
    return 1 if is_point else 2, geometry(parts, is_point)


def encode_layer(name: str, features: list[tuple[list, dict]], z: int, x: int, y: int, tolerance: float = 0.0, polygons: bool = False) -> bytes:
    """A tile with one layer; a feature is (points in degrees, properties), and is left out where it misses the tile.

    For polygons a feature is (rings, properties), a ring (nth, points), nth 0 an outer one and others its holes.
    """
    keys: dict[str, int] = {}
    values: dict[tuple, int] = {}
    body: list[bytes] = []  # joined once: a text of bytes that grows is copied with each feature
    for points, props in features:
        if not points:
            continue
        low, high = -BUFFER, EXTENT + BUFFER
        if polygons:
            kind, commands = 3, ring_geometry([(nth, clip_ring(to_tile(simplify_apart(ring, tolerance) if tolerance else ring, z, x, y), low, high)) for nth, ring in points])
        else:
            kind, commands = _drawn(points, z, x, y, tolerance, low, high)
        if not commands:
            continue
        tags = []
        for k, v in props.items():
            if v is not None:
                tags += [keys.setdefault(k, len(keys)), values.setdefault((type(v).__name__, v), len(values))]
        body.append(_field(2, _field(2, b"".join(map(varint, tags))) + varint(3 << 3) + varint(kind) + _field(4, b"".join(map(varint, commands)))))
    if not body:
        return b""
    layer = _field(1, name.encode()) + b"".join(body) + b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _value(v)) for _, v in values)
    return _field(3, layer + varint(5 << 3) + varint(EXTENT) + varint(15 << 3) + varint(2))


def decode_layer(data: bytes) -> dict:
    """Name, version, extent and number of features of a tile's one layer: a reader for checks."""

    def fields(raw: bytes):
        at = 0

        def number() -> int:
            nonlocal at
            n = shift = 0
            while True:
                b = raw[at]
                at += 1
                n |= (b & 0x7F) << shift
                shift += 7
                if b < 0x80:
                    return n

        while at < len(raw):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            elif tag & 7 == 1:
                at += 8
                yield tag >> 3, raw[at - 8 : at]
            else:
                n = number()
                at += n
                yield tag >> 3, raw[at - n : at]

    out = {"features": [], "keys": []}
    for _, layer in fields(data):
        for f, v in fields(layer):
            if f == 1:
                out["name"] = v.decode()
            elif f == 2:
                out["features"].append(dict(fields(v)))
            elif f == 3:
                out["keys"].append(v.decode())
            elif f in (5, 15):
                out["extent" if f == 5 else "version"] = v
    return out


FEATURES = "z int, x int, y int, layer string, kind int, properties map<string,string>, parts array<array<struct<x:int,y:int>>>"


def read_features(data: bytes) -> list[dict]:
    """The features of a tile: layer, kind (1 point, 2 line, 3 polygon), properties as text and parts in units of the tile."""

    def fields(raw: bytes):
        at = 0

        def number() -> int:
            nonlocal at
            n = shift = 0
            while True:
                b = raw[at]
                at += 1
                n |= (b & 0x7F) << shift
                shift += 7
                if b < 0x80:
                    return n

        while at < len(raw):
            tag = number()
            if tag & 7 == 2:
                n = number()
                at += n
                yield tag >> 3, raw[at - n : at]
            elif tag & 7 == 1:
                at += 8
                yield tag >> 3, struct.unpack("<d", raw[at - 8 : at])[0]
            else:
                yield tag >> 3, number()

    def numbers(raw: bytes) -> list[int]:
        out, n, shift = [], 0, 0
        for b in raw:
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                out.append(n)
                n = shift = 0
        return out

    def parts(commands: list[int]) -> list[list[dict]]:
        out, cx, cy, i = [], 0, 0, 0
        while i < len(commands):
            command, count = commands[i] & 7, commands[i] >> 3
            i += 1
            for _ in range(count if command != 7 else 0):
                dx, dy = (n >> 1 ^ -(n & 1) for n in commands[i : i + 2])
                i, cx, cy = i + 2, cx + dx, cy + dy
                if command == 1:
                    out.append([])
                out[-1].append({"x": cx, "y": cy})
        return out

    def text(raw: bytes) -> str:
        (k, v), *_ = fields(raw)
        return v.decode() if k == 1 else str(bool(v)).lower() if k == 7 else str(v)

    found = []
    for _, layer in fields(data):
        got = list(fields(layer))
        name, keys, values = next(v for k, v in got if k == 1).decode(), [v.decode() for k, v in got if k == 3], [text(v) for k, v in got if k == 4]
        for k, v in got:
            if k == 2:
                f = dict(fields(v))
                tags = numbers(f.get(2, b""))
                found.append({"layer": name, "kind": f[3], "properties": [(keys[a], values[b]) for a, b in zip(tags[::2], tags[1::2], strict=True)], "parts": parts(numbers(f[4]))})
    return found


#: Features handed on at once.
BATCH = 2000


def features_of(encoded: DataFrame) -> DataFrame:
    """FEATURES of tiles (z, x, y, tile)."""
    schema = pa.schema([("z", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("layer", pa.string()), ("kind", pa.int32()), ("properties", pa.map_(pa.string(), pa.string())), ("parts", pa.list_(pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))))])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                found = read_features(r["tile"])
                for i in range(0, len(found), BATCH):
                    yield pa.RecordBatch.from_pylist([{"z": r["z"], "x": r["x"], "y": r["y"], **f} for f in found[i : i + BATCH]], schema)

    return encoded.select("z", "x", "y", "tile").mapInArrow(run, FEATURES)


def tiles(features: DataFrame, layer: str, properties: list[str], tolerance: float = 0.0, polygons: bool = False) -> DataFrame:
    """z, x, y, tile: features (z, x, y, points, properties) encoded tile by tile, in order of their first property.

    For polygons points are rings: an array of structs (nth, ring), see encode_layer.
    """

    def shape(points) -> list:
        if polygons:
            return [(p["nth"], [(q["lon"], q["lat"]) for q in p["ring"]]) for p in points or []]
        return [(p["lon"], p["lat"]) for p in points or []]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        z, x, y = (k.as_py() for k in key)
        rows = sorted(table.to_pylist(), key=lambda r: str(r[properties[0]]))
        data = encode_layer(layer, [(shape(r["points"]), {c: r[c] for c in properties}) for r in rows], z, x, y, tolerance, polygons)
        return pa.table({"z": pa.array([z], pa.int32()), "x": pa.array([x], pa.int32()), "y": pa.array([y], pa.int32()), "tile": pa.array([data], pa.binary())})

    wanted = features.select(*(F.col(c).cast("int").alias(c) for c in "zxy"), "points", *properties)
    return wanted.groupBy("z", "x", "y").applyInArrow(run, "z int, x int, y int, tile binary")

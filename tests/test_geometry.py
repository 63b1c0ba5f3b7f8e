"""Chains, merged lines and unions of polygons against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators import chains, lines, polygons
from tramline.plans.stages import stored

POINT = "struct<lon:double,lat:double>"


def test_ranked_chains_and_rings(spark):
    rng = random.Random(1)
    ids = rng.sample(range(1000), 260)
    following, expected, at = {}, {}, 0
    for size in (1, 1, 2, 3, 40, 90):  # chains
        own = ids[at : at + size]
        at += size
        for i, x in enumerate(own):
            following[x] = own[i + 1] if i + 1 < size else None
            expected[x] = (own[-1], size - 1 - i, False)
    for size in (1, 2, 5, 100):  # rings
        own = ids[at : at + size]
        at += size
        k = own.index(min(own))
        own = own[k:] + own[:k]
        for i, x in enumerate(own):
            following[x] = own[(i + 1) % size]
            expected[x] = (own[-1], size - 1 - i, True)
    links = spark.createDataFrame(list(following.items()), "id long, next long")
    assert {r.id: (r.last, r.left, r.ring) for r in chains.ranked(links, stored).collect()} == expected
    assert chains.ranked(links.where("false"), stored).collect() == []


def brute_merge(parts):
    """(smallest part, line) of each merged line: ends are joined one pair at a time."""
    parts = {k: list(v) for k, v in parts.items() if len(v) >= 2}
    ends = defaultdict(list)
    for k, v in parts.items():
        ends[v[0]].append(k)
        ends[v[-1]].append(k)
    joints = {p for p, ks in ends.items() if len(ks) == 2 and ks[0] != ks[1]}
    out, seen = [], set()
    for k in sorted(parts):
        if k in seen:
            continue
        seen.add(k)
        line = parts[k]
        for forward in (True, False):
            while (p := line[-1] if forward else line[0]) in joints:
                more = [x for x in ends[p] if x not in seen]
                if not more:
                    break
                seen.add(more[0])
                other = parts[more[0]]
                if (other[0] == p) != forward:
                    other = other[::-1]
                line = line + other[1:] if forward else other[:-1] + line
        out.append((k, line))
    return out


def random_parts(rng):
    """Ways of a small grid cut to parts, in any order and direction, with rings, branches and closed lines."""
    out = []
    for _ in range(rng.randint(1, 5)):
        x, y = rng.randint(0, 3), rng.randint(0, 3)
        line = [(x, y)]
        for _ in range(rng.randint(1, 9)):
            x, y = x + rng.choice([-1, 0, 1]), y + rng.choice([-1, 0, 1])
            line.append((x, y))
        while len(line) > 1:
            n = rng.randint(1, 4)
            part, line = line[: n + 1], line[n:]
            out.append(part if rng.random() < 0.5 else part[::-1])
    out += [[(9, 9), (9, 8), (8, 8), (9, 9)], [(20, 1)], []][: rng.randint(0, 3)]
    rng.shuffle(out)
    return dict(enumerate(out))


def test_merged_lines_equal_brute_force(spark):
    rng = random.Random(2)
    ways = {w: random_parts(rng) for w in range(120)}
    long_way = [(i, i % 7) for i in range(300)]
    cut = [long_way[i : i + 2][:: rng.choice([1, -1])] for i in range(299)]
    rng.shuffle(cut)
    ways[500] = dict(enumerate(cut))
    ring = [long_way[i : i + 2] for i in range(50)] + [[(50, 50 % 7), (0, 0)]]
    rng.shuffle(ring)
    ways[501] = dict(enumerate(ring))
    rows = [(w, k, [(float(x), float(y)) for x, y in v]) for w, parts in ways.items() for k, v in parts.items()]
    df = spark.createDataFrame(rows, f"id long, part int, line array<{POINT}>").repartition(4)
    got = defaultdict(dict)
    for r in lines.merge_lines(df, ["id"], stored).collect():
        got[r.id][r.part] = [tuple(p) for p in r.line]
    for w, parts in ways.items():
        expected = brute_merge(parts)
        assert sorted(got[w]) == [k for k, _ in expected], (w, parts)
        for k, line in expected:
            assert got[w][k] == line or (line[0] == line[-1] and sorted(got[w][k][1:]) == sorted(line[1:]) and got[w][k][: len(parts[k])] == parts[k]), (w, parts, got[w][k], line)


def test_any_order_and_direction_gives_the_same_lines(spark):
    rng = random.Random(3)
    parts = [[(i, 0), (i + 1, 0)] for i in range(30)] + [[(15, 0), (15, 1)], [(15, 1), (15, 2)]]
    shapes = []
    for w in range(6):
        own = [p[:: rng.choice([1, -1])] for p in parts]
        rng.shuffle(own)
        shapes += [(w, k, [(float(x), float(y)) for x, y in v]) for k, v in enumerate(own)]
    df = spark.createDataFrame(shapes, f"id long, part int, line array<{POINT}>")
    found = defaultdict(set)
    for r in lines.merge_lines(df, ["id"], stored).collect():
        line = tuple(tuple(p) for p in r.line)
        found[r.id].add(min(line, line[::-1]))
    assert len(found[0]) == 3 and all(found[w] == found[0] for w in found)


def cells_to_rings(rng, cells):
    """Unit squares, each from any corner on and in either direction, some joined to a bar with a hole."""
    out = []
    for n, (x, y) in enumerate(cells):
        ring = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
        k = rng.randint(0, 3)
        ring = (ring[k:] + ring[:k])[:: rng.choice([1, -1])]
        ring = ring if rng.random() < 0.3 else [*ring, ring[0]]
        out.append((n, 0, [(float(a), float(b)) for p in ([ring[0], *ring] if rng.random() < 0.3 else ring) for a, b in [p]]))
    return out


def crossings(x, y, ring):
    return sum((a[1] > y) != (b[1] > y) and x < (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:], strict=False))


@pytest.mark.parametrize("seed", [1, 2])
def test_union_equals_its_cells(spark, seed):
    rng = random.Random(seed)
    groups = {g: sorted({(rng.randint(0, 7), rng.randint(0, 7)) for _ in range(rng.choice([1, 8, 30, 45]))}) for g in range(12)}
    rows = [(f"s{g}", *r) for g, cells in groups.items() for r in cells_to_rings(rng, cells)]
    rows += [("s0", 900, *r[1:]) for r in cells_to_rings(rng, groups[0][:1])]  # the same polygon twice
    rows += [("s1", 901, 0, [(1.0, 1.0), (2.0, 2.0)]), ("s1", 902, 0, [(1.0, 1.0)] * 5), ("s1", 903, 0, [])]
    df = spark.createDataFrame(rows, f"state string, polygon int, nth int, ring array<{POINT}>")
    found = defaultdict(list)
    for r in polygons.union_polygons(df, ["state"], stored).collect():
        ring = [tuple(p) for p in r.ring]
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2
        assert ring[0] == ring[-1] == min(ring) and (area > 0) == r.outer and len(set(zip(ring, ring[1:], strict=False))) == len(ring) - 1
        found[r.state].append((area, ring))
    for g, cells in groups.items():
        rings = found[f"s{g}"]
        assert sum(a for a, _ in rings) == len(cells)
        for x in range(-1, 9):
            for y in range(-1, 9):
                assert sum(crossings(x + 0.5, y + 0.4, ring) for _, ring in rings) % 2 == ((x, y) in cells)
        borders = {((x, y), d) for x, y in cells for d in ((1, 0), (-1, 0), (0, 1), (0, -1)) if (x + d[0], y + d[1]) not in cells}
        assert sum(len(ring) - 1 for _, ring in rings) == len(borders)


def test_a_hole_stays_and_an_enclave_fills_it(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    rows = [("ring", 1, 0, square(0.0, 9.0)), ("ring", 1, 1, square(3.0, 6.0)), ("full", 1, 0, square(0.0, 9.0)), ("full", 1, 1, square(3.0, 6.0)), ("full", 2, 0, square(3.0, 6.0)[::-1])]
    df = spark.createDataFrame(rows, f"state string, polygon int, nth int, ring array<{POINT}>")
    areas = polygons.polygon_areas(polygons.union_polygons(df, ["state"], stored), ["state"])
    assert {r.state: (r.outer_rings, r.holes, r.corners) for r in areas.collect()} == {"ring": (1, 1, 8), "full": (1, 0, 4)}
    inside = spark.createDataFrame([(1.0, 1.0), (4.0, 4.0)], "lon double, lat double").crossJoin(df.limit(1).select("ring"))
    assert [r.h for r in inside.select(geo.ring_contains(F.col("lon"), F.col("lat"), F.col("ring")).alias("h")).collect()] == [True, True]

"""Matching of patterns to rails, from parts of ways to the rating, against the same worked out over dictionaries."""

import datetime
import math
import random
from collections import defaultdict

from tramline.plans import maps


def meters(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(h))


def mercator(p):
    return math.radians(p[0]) * 6378137.0, math.log(math.tan(math.pi / 4 + math.radians(p[1]) / 2)) * 6378137.0


def far(a, b):
    return max(min(math.dist(p, q) for q in b) for p in a)


def brute(suppliers, shipped):
    width = maps.GRID_WIDTH
    keys = dict(suppliers)
    node = lambda k, i=0, j=0: (8 + (k % width + i) / 20, 53 + (k // width + j) / 20)
    edges = []
    for k, rich in suppliers:
        for other, i, j in ((k + 1, 1, 0), (k + width, 0, 1)):
            if other in keys and not (i and k % width == width - 1):
                line = [node(k), node(k, i / 2 + j / 8, j / 2 + i / 8), node(k, i, j)]
                length = sum(meters(a, b) for a, b in zip(line, line[1:], strict=False))
                edges.append((k, other, line, length, rich > 8000))
    stops = {k: tuple(c + (0.02 if rich < 0 else 0.002) for c in node(k)) for k, rich in suppliers}
    snapped = {}
    for k, place in stops.items():
        best = []
        for n, (a, b, line, _, service) in enumerate(edges):
            for p, q in zip(line, line[1:], strict=False):
                c = math.cos(math.radians(place[1]))
                dx, dy = (q[0] - p[0]) * c, q[1] - p[1]
                t = max(0, min(1, ((place[0] - p[0]) * c * dx + (place[1] - p[1]) * dy) / (dx * dx + dy * dy)))
                at = (p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t)
                if math.dist(at, place) <= 0.01 and meters(at, place) <= 800:
                    best.append((meters(at, place), service, n, a if meters(place, line[0]) <= meters(place, line[-1]) else b))
        if best:
            least = min(best)[:2]
            snapped[k] = {b[3] for b in best if b[:2] == least}, least[0]
    around = defaultdict(list)
    for a, b, line, length, service in edges:
        cost = length * (8 if service else 1)
        around[a].append((b, cost, length, service, line))
        around[b].append((a, cost, length, service, line[::-1]))

    def way(s, t):
        done, open_ = {}, {s: (0.0, [])}
        while open_:
            n = min(open_, key=lambda x: open_[x][0])
            cost, path = open_.pop(n)
            done[n] = path
            if n == t:
                return path
            for b, c, length, service, line in around[n]:
                if b not in done and (b not in open_ or cost + c < open_[b][0]):
                    open_[b] = (cost + c, [*path, (length, service, line)])
        return None

    patterns = defaultdict(dict)
    for date, k in shipped:
        month = patterns[date.strftime("%Y-%m")]
        month[date.day] = min(k, month.get(date.day, k))
    out = {}
    for name, days in patterns.items():
        calls = [days[x] for x in sorted(days)]
        total, failed, straight, paths, snaps = 0, 0, 0.0, [], []
        for s, t in zip(calls, calls[1:], strict=False):
            total += 1
            straight += meters(stops[s], stops[t])
            if s in snapped:
                snaps.append(snapped[s][1])
            if s not in snapped or t not in snapped:
                failed += 1
            else:
                (a,), (b,) = snapped[s][0], snapped[t][0]
                if a != b:
                    path = way(a, b)
                    failed += path is None
                    paths += path or []
        if not total:
            continue
        routed = sum(x[0] for x in paths) if paths else None
        detour = routed / straight if routed is not None and straight else None
        own = [mercator(stops[k]) for k in calls]
        rails = [mercator(p) for x in paths for p in x[2]]
        apart = max(far(own, rails), far(rails, own)) if paths else None
        loss = (max(snaps) if snaps else 800) / 800 * 0.25 + failed / total * 0.45 + max((10 if detour is None else detour) - 1.8, 0) * 0.15 + (0.08 if any(x[1] for x in paths) else 0) + min((apart or 0) / 5000, 0.25)
        confidence = min(1, max(0, 1 - loss))
        status = "fallback" if not paths or confidence < 0.45 else "osm_reconstructed" if confidence >= 0.7 else "osm_reconstructed_low_confidence"
        out[name] = (status, total, failed, confidence, detour, len(paths) or None)
    return out


def test_matching_end_to_end(spark, tmp_path):
    rng = random.Random(4)
    suppliers = [(k, rng.choice([-50.0, 10.0, 10.0, 10.0, 9000.0])) for k in range(1, 95) if k not in (20, 41, 42)]
    start = datetime.date(1996, 1, 1)
    shipped = [(start + datetime.timedelta(days=rng.randrange(240)), rng.choice(suppliers[n % 60 : n % 60 + 6])[0]) for n in range(300)] + [(datetime.date(1999, 5, 1), 3), (datetime.date(1999, 6, 1), 3), (datetime.date(1999, 6, 2), 3)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(shipped, "l_shipdate date, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = brute(suppliers, shipped)
    got = {r.pattern_id: r for r in maps.rail_matching(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for name, (status, total, failed, confidence, detour, edges) in want.items():
        r = got[name]
        assert (r.status, r.total_segments, r.failed_segments) == (status, total, failed), name
        assert abs(r.confidence - confidence) < 2e-6 and (r.detour is None) == (detour is None) and abs((r.detour or 0) - (detour or 0)) < 2e-6, name
    assert len({w[0] for w in want.values()}) > 1

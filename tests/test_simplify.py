"""Simplified lines: within tolerance, ends kept, no crossings made."""

import math
import random

import pytest

from tramline.operators import mvt


def meets(p, q, r, s):
    """Whether two steps touch or cross."""
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    on = lambda a, b, c: side(a, b, c) == 0 and min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    proper = (side(p, q, r) > 0) != (side(p, q, s) > 0) and (side(r, s, p) > 0) != (side(r, s, q) > 0) and 0 not in (side(p, q, r), side(p, q, s), side(r, s, p), side(r, s, q))
    return proper or on(p, q, r) or on(p, q, s) or on(r, s, p) or on(r, s, q)


def crossings(line):
    steps = list(zip(line, line[1:], strict=False))
    closed = line[0] == line[-1]
    return sum(meets(*steps[i], *steps[j]) for i in range(len(steps)) for j in range(i + 2, len(steps)) if not (closed and i == 0 and j == len(steps) - 1))


def distance(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = dx * dx + dy * dy
    t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / size)) if size else 0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def wandering(rng, n):
    """A line that never meets itself, folded tightly: random steps that would touch are thrown away."""
    line = [(0.0, 0.0)]
    while len(line) < n:
        for _ in range(60):
            angle = rng.uniform(0, 2 * math.pi)
            p = (line[-1][0] + math.cos(angle), line[-1][1] + math.sin(angle))
            if not any(meets(line[-1], p, a, b) for a, b in zip(line[:-1], line[1:-1], strict=False)):
                line.append(p)
                break
        else:
            return line
    return line


@pytest.mark.parametrize("tolerance", [0.3, 1.0, 4.0])
def test_no_crossing_is_made(tolerance):
    rng, removed, tight = random.Random(3), 0, 0
    for _ in range(25):
        line = wandering(rng, 90)
        out = mvt.simplify_apart(line, tolerance)
        assert crossings(line) == 0 and crossings(out) == 0
        assert out[0] == line[0] and out[-1] == line[-1]
        at = [line.index(p) for p in out]
        assert at == sorted(at)
        assert all(distance(line[k], line[a], line[b]) <= tolerance + 1e-12 for a, b in zip(at, at[1:], strict=False) for k in range(a, b))
        removed += len(line) - len(out)
        tight += crossings(mvt.simplify(line, tolerance)) > 0
    assert removed > 200
    assert tolerance != 1.0 or tight  # the plain way does make crossings on such lines


def test_small_and_closed_lines():
    assert mvt.simplify_apart([], 1) == [] and mvt.simplify_apart([(0, 0)], 1) == [(0, 0)] and mvt.simplify_apart([(0, 0), (1, 1)], 9) == [(0, 0), (1, 1)]
    assert mvt.simplify_apart([(0, 0), (1, 0.01), (2, 0)], 0.1) == [(0, 0), (2, 0)]
    ring = [(math.cos(i / 50 * 2 * math.pi), math.sin(i / 50 * 2 * math.pi)) for i in range(50)]
    out = mvt.simplify_apart([*ring, ring[0]], 5.0)
    assert len(out) == 4 and out[0] == out[-1] and crossings(out) == 0
    assert mvt.simplify_apart([(0, 0)] * 5, 1.0)[0] == (0, 0)


def test_long_lines_in_good_time():
    line = [(i / 10, math.sin(i / 7) + (i * 7919 % 13) / 100) for i in range(20_000)]
    assert 2 < len(mvt.simplify_apart(line, 0.2)) < 4000

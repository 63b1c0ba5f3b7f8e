"""Cheapest ways by searches from both ends, against brute force, and how much they write."""

import collections
import random

from tests.test_whole import cheapest, tangle, write
from tramline.operators import rail
from tramline.plans import catalog, stages

PAIR = "source string, target string"


def ways(spark, edges, pairs):
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "edge_id long, source string, target string, cost double")
    found = collections.defaultdict(list)
    for r in rail.met_paths(df, spark.createDataFrame(pairs, PAIR)).collect():
        found[r.source, r.target].append((r.step, int(r.edge_id), r.cost))
    return found


def test_ways_meet_in_tangles(spark):
    rng = random.Random(7)
    edges, pairs = [], []
    for g in range(5):
        own = [(a, b, c * rng.choice([1, 1 / 3])) for a, b, c in tangle(rng, f"g{g}n")]
        nodes = sorted({n for a, b, _ in own for n in (a, b)})
        edges += own
        pairs += [(rng.choice(nodes), rng.choice(nodes)) for _ in range(8)] + [(f"g{g}nr0", f"g{g}nr3"), (nodes[0], "nowhere")]
    found = ways(spark, edges, pairs + pairs[:3])
    want = {}
    for s, t in pairs:
        costs = cheapest(edges, s)
        if s != t and t in costs:
            want[s, t] = costs[t]
    assert set(found) == set(want) and len(want) > 20
    for (s, t), way in found.items():
        assert abs(sum(c for *_, c in way) - want[s, t]) < 1e-9 and sorted(x[0] for x in way) == list(range(len(way)))
        at = s
        for _, e, c in sorted(way):
            a, b, cost = edges[e]
            assert at in (a, b) and c == cost
            at = b if at == a else a
        assert at == t


def test_a_dear_edge_in_the_middle(spark):
    edges = [("a", "b", 1.0), ("b", "c", 50.0), ("c", "d", 1.0), ("a", "x", 20.0), ("x", "y", 20.0), ("y", "d", 20.0), ("u", "v", 0.0)]
    found = ways(spark, edges, [("a", "d"), ("d", "a"), ("u", "v"), ("v", "a")])
    assert {k: [e for _, e, _ in sorted(w)] for k, w in found.items()} == {("a", "d"): [0, 1, 2], ("d", "a"): [2, 1, 0], ("u", "v"): [6]}


def test_no_edges_no_pairs_and_costs_that_are_none(spark):
    assert ways(spark, [("a", "b", 1.0)], [("a", "b")]) == {("a", "b"): [(0, 0, 1.0)]}
    df = spark.createDataFrame([(1, "a", "b", 1.0), (2, "c", "d", None)], "edge_id long, source string, target string, cost double")
    pairs = spark.createDataFrame([("a", "b"), ("c", "d")], PAIR)
    assert [tuple(r) for r in rail.met_paths(df, pairs).collect()] == [("a", "b", 0, "1", 1.0)]
    assert rail.met_paths(df, pairs.where("false")).collect() == []
    assert rail.met_paths(df.where("false"), pairs).collect() == []


def test_only_what_lies_between_near_stops_is_written(spark, tmp_path, monkeypatch):
    rows = [(s, p) for p in range(900) for s in range(16)]
    d = write(spark, tmp_path, "lineitem", rows, "l_suppkey long, l_partkey long")
    sizes, stored = [], stages.stored

    def counted(df):
        out = stored(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(stages, "stored", counted)
    got = {(r.source, r.target): (r.steps, r.cost) for r in catalog.QUERIES["shortest_paths"](spark, d).collect()}
    keys = {s * 7 % 1000 for s, _ in rows}
    assert got == {(f"s{k}", f"s{k + 7}"): (2, 2.0) for k in keys if k + 7 in keys} and len(got) == 15
    cheap = sum(p % 17 < 2 for _, p in rows)
    assert max(sizes) <= cheap

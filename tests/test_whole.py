"""Registered queries against brute force over every row of small tables."""

import collections
import datetime
import random

from tramline.operators import rail
from tramline.plans import catalog
from tramline.plans.stages import stored


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def cheapest(edges, start):
    """Cost from start to every node it reaches, by relaxing all edges until nothing changes."""
    cost, changed = {start: 0.0}, True
    while changed:
        changed = False
        for a, b, c in edges:
            for x, y in ((a, b), (b, a)):
                if x in cost and cost[x] + c < cost.get(y, float("inf")):
                    cost[y], changed = cost[x] + c, True
    return cost


def test_graph_of_all_line_items(spark, tmp_path):
    rows = [(s, p) for p in range(1, 60) for s in (p % 11, p * 5 % 11) if p % 6] + [(20, 200), (21, 200), (22, 201)]
    d = write(spark, tmp_path, "lineitem", rows, "l_suppkey long, l_partkey long")
    edges = {(f"s{s * 7 % 1000}", f"p{p}", float(p % 17 + 1)) for s, p in rows}
    nodes = {n for a, b, _ in edges for n in (a, b)}
    costs = {n: cheapest(edges, n) for n in nodes}
    got = {r.node: r.component for r in catalog.QUERIES["components"](spark, d).collect()}
    assert got == {n: min(costs[n]) for n in nodes}
    stops = {a for a, _, _ in edges}
    asked = [(s, f"s{int(s[1:]) + 7}") for s in stops]
    want = {(s, t): costs[s][t] for s, t in asked if t in stops and t in costs[s]}
    got = {(r.source, r.target): r.cost for r in catalog.QUERIES["shortest_paths"](spark, d).collect()}
    assert len(want) >= 5 and got == want


def tangle(rng, name):
    """A random graph with long chains, parallel edges, loops, dead ends, a ring of its own and edges that cost nothing."""
    edges = [(f"{name}{rng.randrange(9)}", f"{name}{rng.randrange(9)}", float(rng.randrange(6))) for _ in range(rng.randrange(4, 22))]
    out = []
    for a, b, c in edges:
        at = a
        for i in range(rng.choice([0, 0, 1, 5])):
            n = f"{a}-{b}-{len(out)}-{i}"
            out.append((at, n, float(rng.randrange(4))))
            at = n
        out.append((at, b, c))
    out += [(f"{name}r{i}", f"{name}r{(i + 1) % 5}", 1.0) for i in range(5)]
    out = [(a, b, c) if rng.random() < 0.5 else (b, a, c) for a, b, c in out]
    rng.shuffle(out)
    return out


def test_ways_through_tangles(spark):
    rng = random.Random(5)
    edges, pairs = [], []
    for g in range(14):
        own = tangle(rng, f"g{g}n")
        nodes = sorted({n for a, b, _ in own for n in (a, b)})
        edges += own
        pairs += [(rng.choice(nodes), rng.choice(nodes)) for _ in range(8)] + [(f"g{g}nr0", f"g{g}nr3")]
    df = stored(spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "edge_id long, source string, target string, cost double"))
    found = collections.defaultdict(list)
    for r in rail.shortest_paths(df, spark.createDataFrame(pairs + pairs[:3], "source string, target string"), rail.components(df, stored)).collect():
        found[r.source, r.target].append((r.step, int(r.edge_id), r.cost))
    want = {}
    for s, t in pairs:
        costs = cheapest(edges, s)
        if s != t and t in costs:
            want[s, t] = costs[t]
    assert set(found) == set(want) and len(want) > 60
    for (s, t), way in found.items():
        assert sum(c for *_, c in way) == want[s, t] and sorted(x[0] for x in way) == list(range(len(way)))
        at = s
        for _, e, c in sorted(way):
            a, b, cost = edges[e]
            assert at in (a, b) and c == cost
            at = b if at == a else a
        assert at == t


def test_no_edges_or_pairs(spark):
    edges = spark.createDataFrame([("e", "a", "b", 1.0)], "edge_id string, source string, target string, cost double")
    pairs = spark.createDataFrame([("a", "b")], "source string, target string")
    labels = rail.components(edges, stored)
    assert [tuple(r) for r in rail.shortest_paths(edges, pairs, labels).collect()] == [("a", "b", 0, "e", 1.0)]
    assert rail.shortest_paths(edges, pairs.where("false"), labels).collect() == []
    assert rail.shortest_paths(edges.where("false"), pairs, rail.components(edges.where("false"), stored)).collect() == []


def test_every_order_has_service_dates(spark, tmp_path):
    start = datetime.date(2024, 1, 1)
    orders = [(k, start + datetime.timedelta(days=k % 9)) for k in range(60)]
    d = write(spark, tmp_path, "orders", orders, "o_orderkey long, o_orderdate date")
    want = {}
    for k, a in orders:
        b = a + datetime.timedelta(days=k % 20)
        for i in range((b - a).days + 1):
            if (a + datetime.timedelta(days=i)).isoweekday() <= 5:
                want[k, str(a + datetime.timedelta(days=i))] = (True, "calendar")
        want[k, str(b + datetime.timedelta(days=1))] = (True, "calendar_dates")
        if k % 2 == 0:
            want[k, str(a)] = (False, "calendar_dates")
    got = catalog.QUERIES["service_dates"](spark, d).collect()
    assert len(got) == len(want) and {(r.service_id, r.service_date): (r.is_active, r.source) for r in got} == want


def test_every_snapshot_and_customer_is_there(spark, tmp_path):
    d = write(spark, tmp_path, "orders", [(k,) for k in range(130)], "o_orderkey long")
    got = {r.public_id: (r.status, r.is_active) for r in catalog.QUERIES["activate_snapshot"](spark, d).collect()}
    assert got == {k: ("active" if k == 10 else "archived" if k == 3 else "imported", k == 10) for k in range(130)}
    balance = {k: float(k % 7 - 3) for k in range(130)}
    write(spark, tmp_path, "customer", list(balance.items()), "c_custkey long, c_acctbal double")
    got = sorted((r.place, r.value, r.kind) for r in catalog.QUERIES["orphan_places"](spark, d).collect())
    kids = collections.defaultdict(list)
    for k, v in balance.items():
        if k % 5:
            kids[k - k % 7].append(v)
    mean = lambda k: round(sum(kids[k]) / len(kids[k]), 6) if kids[k] else None
    parents = [(k, v if v > 0 else mean(k), "parent") for k, v in balance.items() if k % 5 == 0]
    orphans = [(k, v, "orphan") for k, v in balance.items() if k % 5 and (k - k % 7) % 5]
    assert got == sorted(parents + orphans)
    assert any(kids[k] for k, *_ in parents) and len(orphans) < sum(map(len, kids.values()))


def test_names_of_every_language(spark, tmp_path):
    docs = [(1, "Köln Hbf\nx", "de"), (2, "Gare de l'Été – Besançon", "fr"), (3, "Estación Ñuñoa, Málaga", "es"), (4, "Łódź Straße", None), (5, None, "fr")]
    d = write(spark, tmp_path, "documents", docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r.name for r in catalog.QUERIES["name_normalise"](spark, d).collect()}
    assert got == {1: "koeln hauptbahnhof", 2: "gare de l ete besancon", 3: "estacion nunoa malaga", 4: "lodz strasse", 5: None}


def test_scan_covers_the_sample_grid(spark, tmp_path):
    rows = [(1, n, s, n, q, 1.0, 0.0, 0.0, "d", "N", "O") for n, s, q in ((1, 1, 60.0), (2, 2, 70.0))] + [(2, n, s, n, q, 1.0, 0.0, 0.0, "d", "N", "O") for n, s, q in ((1, 1, 1400.0), (2, 3, 1420.0))]
    d = write(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate string, l_returnflag string, l_linestatus string")
    trips = [("2", 60 * 60 + 330, 70 * 60 + 600), ("3", 1400 * 60 + 330, 1420 * 60 + 600)]
    want = sorted((t, stop, arr - t, 1) for t in range(0, 28 * 3600, 300) for stop, dep, arr in trips if t <= dep and arr <= t + 7200)
    got = catalog.QUERIES["reachability_scan"](spark, d).collect()
    assert max(t for t, *_ in want) > 80000 and sorted((r.sample, r.stop, r.seconds, r.legs) for r in got) == want

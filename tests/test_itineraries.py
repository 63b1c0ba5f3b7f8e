"""Itineraries against all journeys of small timetables, one by one."""

import random
from collections import defaultdict

import pytest

from tramline.operators import itineraries
from tramline.plans import catalog
from tramline.plans.stages import stored
from tests.test_rounds import day


def journeys(connections, walks, origin, destination, after, before, horizon, change, most):
    """(departure, arrival, changes, walk) of every journey there is."""
    foot = defaultdict(dict)
    for a, b, s in walks:
        if a != b:
            foot[a][b] = min(s, foot[a].get(b, s))
    trips = defaultdict(list)
    for c in connections:
        trips[c[0]].append(c)
    out = set()

    def ride(stop, ready, departed, walked, rides):
        for of in trips.values():
            for _, a, _, dep, arr, board, _ in of:
                if not board or a != stop or dep < ready or dep > after + horizon:
                    continue
                begun = dep - walked if departed is None else departed
                if begun > before:
                    continue
                for _, _, b, dep2, arr2, _, alight in of:
                    if alight and (dep2, arr2) >= (dep, arr) and arr2 <= after + horizon:
                        if b == destination:
                            out.add((begun, arr2, rides, walked))
                        elif destination in foot[b] and arr2 + foot[b][destination] <= after + horizon:
                            out.add((begun, arr2 + foot[b][destination], rides, walked + foot[b][destination]))
                        if rides + 1 < most:
                            ride(b, arr2 + change, begun, walked, rides + 1)
                            for to, s in foot[b].items():
                                ride(to, arr2 + s, begun, walked + s, rides + 1)

    ride(origin, after, None, 0, 0)
    for to, s in foot[origin].items():
        ride(to, after + s, None, s, 0)
    better = lambda x, y: x != y and x[0] >= y[0] and x[1] <= y[1] and x[2] <= y[2] and x[3] <= y[3]
    return {y for y in out if not any(better(x, y) for x in out)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_itineraries_equal_all_journeys(spark, seed):
    rng = random.Random(seed)
    days = {d: day(rng, trips=16, stops=7) for d in ("d1", "d2")}
    walks = [(f"s{rng.randrange(7)}", f"s{rng.randrange(7)}", rng.randint(30, 500)) for _ in range(6)]
    asked = [(f"q{i}", rng.choice(["d1", "d2", "d3"]), f"s{rng.randrange(7)}", f"s{rng.randrange(7)}", a := rng.randint(0, 3000), a + rng.choice([600, 3000])) for i in range(14)] + [("same", "d1", "s1", "s1", 0, 9000)]
    con = spark.createDataFrame([(d, *c) for d, cs in days.items() for c in cs], "date string, trip string, a string, b string, dep long, arr long, board boolean, alight boolean")
    foot = spark.createDataFrame(walks, "from_stop_id string, to_stop_id string, seconds int")
    q = spark.createDataFrame(asked, "query string, date string, origin string, destination string, after int, before int")
    got, legs = defaultdict(set), {}
    for r in itineraries.search(q, con, foot, 4000, 60, 3).collect():
        vector = (r.departure, r.arrival, r.changes, r.walk_s)
        assert vector not in got[r.query] and len(r.legs) == r.changes + 1
        got[r.query].add(vector)
        legs[r.query, vector] = r.legs
    want = {i: journeys(days.get(d, []), walks, o, t, a, b, 4000, 60, 3) for i, d, o, t, a, b in asked if o != t}
    assert dict(got) == {i: v for i, v in want.items() if v}
    assert sum(len(v) for v in want.values()) > 8
    for (i, vector), way in legs.items():
        date = next(d for n, d, *_ in asked if n == i)
        for x in way:
            of = [c for c in days[date] if c[0] == x.trip]
            assert any(c[1] == x.origin and c[3] == x.departure and c[5] for c in of) and any(c[2] == x.destination and c[4] == x.arrival and c[6] for c in of)
        assert all(b.departure >= a.arrival for a, b in zip(way, way[1:], strict=False)) and way[-1].arrival <= vector[1]


def test_no_questions(spark):
    con = spark.createDataFrame([], "date string, trip string, a string, b string, dep long, arr long, board boolean, alight boolean")
    foot = spark.createDataFrame([], "from_stop_id string, to_stop_id string, seconds int")
    q = spark.createDataFrame([], "query string, date string, origin string, destination string, after int, before int")
    assert itineraries.search(q, con, foot).collect() == []


def test_query_over_written_tables(spark, tmp_path):
    rng, lines = random.Random(6), []
    for order in range(1, 70):
        for n in range(1, rng.randint(2, 7)):
            lines.append((order, n, rng.randint(1, 9), float(rng.randint(1, 30)), rng.choice("RAN"), "O"))
    spark.createDataFrame([(*x, 1, 1.0, 0.0, 0.0, "1996-01-01") for x in lines], "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string, l_partkey long, l_extendedprice double, l_discount double, l_tax double, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    nation = {k: k % 3 for k in range(1, 10)}
    spark.createDataFrame(list(nation.items()), "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    connections = []
    for order in range(1, 70):
        calls = sorted((n, str(s), int(q * 60 + n * 300), flag) for o, n, s, q, flag, _ in lines if o == order)
        connections += [(str(order), a, b, t + 30, u, flag != "R", True) for (_, a, t, flag), (_, b, u, _) in zip(calls, calls[1:], strict=False) if u >= t + 30]
    walks = [(str(k), str(k + 3), 240) for k in range(1, 7)]
    got = defaultdict(set)
    for r in catalog.QUERIES["itinerary_search"](spark, str(tmp_path)).collect():
        got[r.query].add((r.departure, r.arrival, r.changes, r.walk_s))
    want = {}
    for n in range(3):
        own = [k for k in nation if nation[k] == n]
        want[n] = journeys(connections, walks, str(min(own)), str(max(own)), 600, 2400, 5400, 60, 3)
    assert dict(got) == {n: v for n, v in want.items() if v} and sum(map(len, want.values())) > 3


def test_rides_that_lead_elsewhere_are_not_followed_to_the_end(spark):
    # from a hub 30 trips lead to places of their own, from each 30 more; one of these places has a trip to the destination
    con = [(f"x{i}", "hub", f"m{i}", 100, 200, True, True) for i in range(30)]
    con += [(f"y{i}-{j}", f"m{i}", f"e{i}-{j}", 300, 400, True, True) for i in range(30) for j in range(30)]
    con += [("z", "m7", "end", 500, 600, True, True), ("late", "m8", "end", 500, 9600, True, True)]
    foot = spark.createDataFrame([], "from_stop_id string, to_stop_id string, seconds int")
    frame = spark.createDataFrame([("d", *c) for c in con], "date string, trip string, a string, b string, dep long, arr long, board boolean, alight boolean")
    q = spark.createDataFrame([("q", "d", "hub", "end", 0, 200)], "query string, date string, origin string, destination string, after int, before int")
    rows = []

    def counted(df):
        out = stored(df)
        rows.append(out.count())
        return out

    got = itineraries.search(q, frame, foot, 4000, 60, 2, store=counted).collect()
    assert [(r.query, r.departure, r.arrival, r.changes, [x.trip for x in r.legs]) for r in got] == [("q", 100, 600, 1, ["x7", "z"])]
    assert sum(rows) - len(con) < 60

"""Earliest arrivals and metric runs against a search written out over dictionaries."""

import random
from collections import defaultdict

import pytest

from tramline.operators import metrics_run, routing
from tramline.plans import catalog
from tramline.plans.stages import stored

INF = 1 << 40


def scan(connections, walks, origins, start, horizon, change):
    """{stop: (seconds, fewest rides)}: connections (trip, a, b, dep, arr, board, alight) gone through until nothing changes, a ride more each time."""
    foot = defaultdict(list)
    for a, b, s in walks:
        if a != b:
            foot[a].append((b, s))
    ready, found = {}, {}
    for o in origins:
        for stop, s in [(o, 0), *foot[o]]:
            ready[stop] = min(ready.get(stop, INF), start + s)
    for rides in range(1, 99):
        since = {}
        for trip, a, _, dep, arr, board, _ in connections:
            if board and ready.get(a, INF) <= dep <= start + horizon:
                since[trip] = min(since.get(trip, (INF, INF)), (dep, arr))
        after = dict(ready)
        for trip, _, b, dep, arr, _, alight in connections:
            if alight and trip in since and (dep, arr) >= since[trip] and arr <= start + horizon:
                if arr - start < found.get(b, (INF, 0))[0]:
                    found[b] = (arr - start, rides)
                for stop, s in [(b, change), *foot[b]]:
                    after[stop] = min(after.get(stop, INF), arr + s)
        if after == ready:
            return found
        ready = after
    raise AssertionError("no end")


def day(rng, trips=40, stops=12):
    out = []
    for t in range(trips):
        at = rng.randint(0, 6000)
        path = rng.sample(range(stops), rng.randint(2, 7))
        for a, b in zip(path, path[1:], strict=False):
            arr = at + rng.randint(0, 600)
            out.append((f"t{t}", f"s{a}", f"s{b}", at, arr, rng.random() < 0.85, rng.random() < 0.85))
            at = arr + rng.randint(0, 120)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_samples_equal_the_scan(spark, seed):
    rng = random.Random(seed)
    days = {f"2026-07-0{i}": day(rng) for i in (6, 7)}
    walks = [(f"s{rng.randrange(12)}", f"s{rng.randrange(12)}", rng.randint(10, 400)) for _ in range(8)]
    samples = [(d, s) for d in days for s in range(0, 7200, 900)] + [("2026-07-08", 0)]
    con = spark.createDataFrame([(d, *c) for d, cs in days.items() for c in cs], "date string, trip string, a string, b string, dep long, arr long, board boolean, alight boolean")
    grid = spark.createDataFrame(samples + samples[:2], "date string, sample int")
    foot = spark.createDataFrame(walks, "from_stop_id string, to_stop_id string, seconds int")
    got = defaultdict(dict)
    for r in routing.reach(grid, con, foot, ["s0", "s1", "none"], 3600, 45).collect():
        got[r.date, r.sample][r.stop] = (r.seconds, r.legs)
    expected = {(d, s): scan(days.get(d, []), walks, ["s0", "s1", "none"], s, 3600, 45) for d, s in samples}
    assert dict(got) == {k: v for k, v in expected.items() if v}
    assert any(legs > 1 for v in expected.values() for _, legs in v.values())


def test_query_over_a_day_equals_the_scan(spark, tmp_path):
    lines, rng = [], random.Random(9)
    for order in range(1, 60):
        for n in range(1, rng.randint(2, 8)):
            lines.append((order, n, rng.randint(1, 9), float(rng.randint(1, 50)), rng.choice("RAN"), rng.choice("FO")))
    spark.createDataFrame([(*x, 1, 1.0, 0.0, 0.0, "1996-01-01") for x in lines], "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string, l_partkey long, l_extendedprice double, l_discount double, l_tax double, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    priorities = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    service = {o: priorities[o % 5] for o in range(1, 60)}
    spark.createDataFrame(list(service.items()), "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k,) for k in range(1, 13)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")

    def connections(orders):
        out = []
        for o in orders:
            calls = sorted((n, str(s), int(q * 60 + n * 300), flag, status) for order, n, s, q, flag, status in lines if order == o)
            for (_, a, arr0, flag, _), (_, b, arr1, _, status) in zip(calls, calls[1:], strict=False):
                if arr1 >= arr0 + 30:
                    out.append((str(o), a, b, arr0 + 30, arr1, flag != "R", True))
        return out

    got = defaultdict(dict)
    for r in catalog.QUERIES["reachability_scan"](spark, str(tmp_path)).collect():
        got[r.sample][r.stop] = (r.seconds, r.legs)
    every = connections(service)
    expected = {s: scan(every, [], ["1"], s, 7200, 60) for s in range(0, 28 * 3600, 300)}
    assert len(expected) == 336 and dict(got) == {s: v for s, v in expected.items() if v}

    # three dates, each with services of its own
    rows = defaultdict(list)
    for date in (7, 8, 9):
        today = connections(o for o in service if date >= int(service[o][0]) + 5)
        night = [(f"{t}n", a, b, dep - 86400, arr - 86400, on, off) for t, a, b, dep, arr, on, off in connections(o for o in service if date - 1 >= int(service[o][0]) + 5) if dep >= 86400]
        for s in range(0, 3600, 300):
            for stop, (seconds, legs) in scan(today + night, [], ["1"], s, 5400, 60).items():
                if (minute := (seconds + 30) // 60 * 60) <= 5400:
                    rows[stop].append(((20640 + date - 6) * 86400 + s, minute, legs))
    for r in catalog.QUERIES["profile_run"](spark, str(tmp_path)).collect():
        own = sorted(rows[r.destination[1:]])
        assert (r.reachable_count, r.sample_count) == (len(own), 36)
        if own:
            at = [x[0] for x in own]
            gaps = [b - a for a, b in zip(at, at[1:], strict=False)]
            assert (r.fastest_s, r.first_sample, r.last_sample, r.max_gap, r.min_transfers, r.direct_count) == (min(x[1] for x in own), at[0], at[-1], max(gaps, default=None), min(x[2] for x in own) - 1, sum(x[2] == 1 for x in own))
    assert any(len({x[0] // 86400 for x in own}) == 3 for own in rows.values())


def test_services_of_the_day_before_count_past_midnight(spark):
    dates = spark.sql("select * from values ('a', date'2026-07-06', true), ('b', date'2026-07-07', true), ('b', date'2026-07-06', false) t(service_id, service_date, is_active)")
    samples = spark.createDataFrame([("2026-07-07", 0), ("2026-07-07", 5)], "date string, sample int")
    assert {tuple(r) for r in metrics_run.active_services(dates, samples).collect()} == {("2026-07-07", "a", 1), ("2026-07-07", "b", 0)}


def test_a_date_without_the_origin_is_refused(spark):
    con = spark.createDataFrame([("d1", "x", "o"), ("d2", "x", "y")], "date string, a string, b string")
    metrics_run.check_origin(con.where("date = 'd1'"), ["o"])
    with pytest.raises(ValueError, match="d2"):
        metrics_run.check_origin(con, ["o"])


def test_rounds_do_not_grow_with_the_samples(spark):
    chain = [(f"t{i}", f"s{i}", f"s{i + 1}", 6000 + 300 * i, 6200 + 300 * i, True, True) for i in range(4)]
    con = spark.createDataFrame([("d", *c) for c in chain], "date string, trip string, a string, b string, dep long, arr long, board boolean, alight boolean")
    foot = spark.createDataFrame([], "from_stop_id string, to_stop_id string, seconds int")
    rows = []

    def counted(df):
        out = stored(df)
        rows.append(out.count())
        return out

    samples = list(range(0, 6000, 100))
    got = routing.reach(spark.createDataFrame([("d", s) for s in samples], "date string, sample int"), con, foot, ["s0"], 6700, 60, store=counted).collect()
    assert {(r.sample, r.stop): (r.seconds, r.legs) for r in got} == {(s, stop): x for s in samples for stop, x in scan(chain, [], ["s0"], s, 6700, 60).items()}
    # all samples catch the same trips: a round finds one row a stop, and keeps what it was given at the origin
    assert len(got) > 60 and all(n <= len(samples) + 4 for n in rows) and sum(n <= 4 for n in rows) >= 5


def test_stored_connections_are_not_stored_again(spark):
    con = stored(spark.createDataFrame([("d", "t", "s0", "s1", 10, 20, True, True)], "date string, trip string, a string, b string, dep long, arr long, board boolean, alight boolean"))
    foot = spark.createDataFrame([], "from_stop_id string, to_stop_id string, seconds int")
    seen = []
    got = routing.reach(spark.createDataFrame([("d", 0)], "date string, sample int"), con, foot, ["s0"], 100, store=lambda df: seen.append(df.columns) or stored(df))
    assert [(r.stop, r.seconds, r.legs, r.position) for r in got.collect()] == [("s1", 20, 1, 0)] and not any("trip" in c for c in seen)

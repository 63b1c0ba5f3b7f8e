"""Functions, feeds and operators on small inputs."""

import json
import math
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tramline.functions import geo, modes, text, times
from tramline.operators import calendar, journeys, metrics, mvt, normalise, poi, rail, research, routing, store
from tramline.plans import api
from tramline.plans.stages import stored
from tramline.sources import files, gtfs

FEED = {
    "agency": "agency_id,agency_name,agency_url,agency_timezone\na,Rail,http://a,Europe/Berlin\n",
    "stops": "stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station,platform_code\n"
    "c,Central  Hall,,,1,,\nc1,Central 1,53.55,10.00,0,c,1\nc2,Central 2,53.57,10.02,0,c,2\nm,Mill,53.60,10.20,1,,\nm1,Mill 1,53.60,10.20,0,m,1\nf1,Far,53.70,10.40,0,lost,\ng,Gone,,,0,,\n",
    "routes": "route_id,agency_id,route_short_name,route_long_name,route_type,route_color\nr,a,RE1,,2,FF0000\nb,a,7,Loop,700,\n",
    "trips": "route_id,service_id,trip_id,direction_id,shape_id\nr,w,t1,0,s1\nr,w,t2,0,s1\nb,w,t3,0,\nx,w,t9,0,\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,pickup_type,drop_off_type\n"
    "t1,08:00:00,08:00:00,c1,1,0,0\nt1,08:20:00,08:21:00,m1,2,0,0\nt2,25:00:00,25:00:00,c1,1,0,0\nt2,25:20:00,25:20:00,m1,2,0,0\nt3,08:30:00,08:30:00,m1,1,0,1\nt3,,,c2,2,0,0\nt3,08:50:00,08:50:00,m1,3,,\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nw,1,1,1,1,1,0,0,20260706,20260712\n",
    "calendar_dates": "service_id,date,exception_type\nw,20260711,1\nw,20260707,2\n",
    "shapes": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence,shape_dist_traveled\ns1,53.60,10.20,2,1250.5\ns1,53.55,10.00,1,10.5\n",
}


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("feed")
    with zipfile.ZipFile(d / "f.zip", "w") as z:
        for name, body in FEED.items():
            z.writestr(f"inner/{name}.txt", ("﻿" if name == "stops" else "") + body)
        z.writestr("readme.md", "x")
    folder = gtfs.extract_feed(str(d / "f.zip"), str(d / "out"))
    assert gtfs.extract_feed("missing.zip", folder) == folder
    assert gtfs.archive_counts(str(d / "f.zip"))["stops.txt"] == 7
    assert len(gtfs.validate_folder(folder)) == 64
    return gtfs.read_feed(spark, folder)


@pytest.fixture(scope="module")
def tables(feed):
    return {k: v.cache() for k, v in normalise.normalise(feed).items()}


def one(df):
    return df.collect()[0]


def value(spark, column):
    return one(spark.range(1).select(column.alias("v"))).v


def test_feed_is_described(feed):
    r = one(gtfs.inspect_feed(feed))
    assert (r.stops, r.parents, r.children, r.routes, r.trips, r.trips_without_shape, r.stop_times, r.departures_after_midnight) == (7, 2, 4, 2, 4, 2, 7, 2)
    assert r.sample_names[0] == "central 1"
    assert tuple(one(gtfs.feed_span(feed))) == ("20260706", "20260712")
    assert set(feed["transfers"].columns) >= {"from_stop_id", "min_transfer_time"}


def test_missing_member_is_an_error(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("stop_id\n1\n")
    with pytest.raises(FileNotFoundError):
        gtfs.read_feed(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        gtfs.validate_folder(str(tmp_path))


def test_normalised_tables(tables):
    places = {r.public_id: r for r in tables["stop_places"].collect()}
    assert set(places) == {"c", "m", "f1"}  # the orphan is a place of its own, the one without coordinates is none
    assert places["c"].lat == pytest.approx(53.56) and places["c"].normalized_name == "central hall" and places["c"].identity_quality == "missing_dhid"
    assert places["c"].modes == ["BUS", "RE"] and places["f1"].modes == []
    assert {r.stop_id for r in tables["stops"].collect()} == {"c", "c1", "c2", "m", "m1"}  # an orphan is no stop
    assert {(r.route_id, r.mode) for r in tables["routes"].collect()} == {("r", "RE"), ("b", "BUS")}
    patterns = {r.route_id: r for r in tables["route_patterns"].collect()}
    assert patterns["r"].trips == 2 and patterns["r"].representative == "t1" and patterns["r"].geometry_quality == "official_gtfs" and patterns["r"].shape_distance == 1240.0
    assert patterns["b"].geometry_quality == "stop_sequence_approximation" and patterns["r"].length_m == pytest.approx(14350, rel=0.02)
    assert {(r.route_id, r.from_id, r.to_id) for r in tables["route_stop_segments"].collect()} == {("r", "c", "m"), ("b", "c", "m")}
    assert tables["stop_times"].where("arrival_s is null").count() == 1


def test_calendar(tables):
    rows = {str(r.service_date): r for r in tables["service_dates"].collect()}
    assert len(rows) == 6 and not rows["2026-07-07"].is_active and rows["2026-07-11"].is_active and rows["2026-07-11"].source == "calendar_dates"
    v = one(calendar.validity(tables["service_dates"]))
    assert (str(v.valid_from), str(v.valid_until), v.rows) == ("2026-07-06", "2026-07-11", 6)


def live(spark, tables):
    control = spark.createDataFrame([("old", "archived", False, None), ("now", "active", True, '{"trips": 3}')], "public_id string, status string, is_active boolean, quality_report string")
    frames = {k: v.withColumn("snapshot_id", F.lit("now")) for k, v in tables.items()}
    frames["stop_places"] = frames["stop_places"].withColumn("state_code", F.lit("HH"))
    runs = spark.createDataFrame([("m1", "p", "2026-01-02", "2026-01-01"), ("m2", "p", None, "2026-02-01")], "id string, profile string, completed_at string, started_at string")
    od = spark.createDataFrame([("m1", "m", "p", "2026-01-02", 1200, 1300.0, 2), ("m0", "m", "p", "2025-01-02", 99, 99.0, 9)], "metric_run_id string, destination string, profile string, computed_at string, fastest_s int, median_s double, direct_count long")
    places = spark.createDataFrame([("p1", "Gut A_1", "gut", "SH", "Weg 1", "w", 10.0, 53.55, None), ("p2", "Hof", "hof", "HH", None, None, 10.1, 53.6, None), ("p3", "Gut weg", "gut", "SH", None, None, 10.1, 53.6, "2024-01-01")], "id string, name string, category string, state_code string, address string, website string, lon double, lat double, deleted_at string")
    return api.Tables(frames | {"snapshots": control, "metric_runs": runs, "od_metrics": od, "places": places})


def test_service_questions(spark, tables):
    t = live(spark, tables)
    assert one(api.current_snapshot(t.__class__(t.frames | {"snapshots": t.frames["snapshots"].withColumns({"valid_from": F.lit(1), "valid_until": F.lit(2)})}))).trips == 3
    assert [r.public_id for r in api.search_stops(t).collect()] == ["c", "f1", "m"]
    assert [r.public_id for r in api.search_stops(t, "CENT", ["HH"], ["RE"]).collect()] == ["c"]
    assert [r.public_id for r in api.search_stops(t, "M_ll").collect()] == ["m"]
    with pytest.raises(ValueError):
        api.search_stops(t, limit=0)
    assert [r.short_name for r in one(api.stop_details(t, "m")).routes] == ["7", "RE1"]
    direct = {r.destination: r.trips for r in api.direct_trips(t, "c", "2026-07-08").collect()}
    assert direct == {"m": 3} and not api.direct_trips(t, "c", "2026-07-07").collect()
    assert one(api.stop_metrics(t, "m", "p", "c", "2026-07-08")).direct_trips_of_day == 3 and one(api.stop_metrics(t, "m", "p")).fastest_s == 1200
    pattern = one(tables["route_patterns"].where("route_id = 'r'")).pattern_id
    r = one(api.route_pattern(t, pattern))
    assert [s.stop_place_id for s in r.stops] == ["c", "m"] and json.loads(r.geojson)["type"] == "LineString"
    assert [r.id for r in api.list_places(t).collect()] == ["p1", "p2"] and [r.id for r in api.list_places(t, "a_", ["gut"], ["SH"]).collect()] == ["p1"]
    changed = {r.id: r for r in api.update_place(t["places"], "p1", {"name": None, "address": None, "website": "new"}).collect()}["p1"]
    assert (changed.name, changed.address, changed.website) == ("Gut A_1", None, "new")
    with pytest.raises(ValueError):
        api.update_place(t["places"], "p1", {"category": "church"})


def test_tiles(spark, tables):
    t = live(spark, tables)
    x, y = (value(spark, c) for c in geo.tile_of(F.lit(10.0), F.lit(53.56), 9))
    stops = mvt.decode_layer(one(api.stop_tile(t, 9, x, y, profile="p")).tile)
    assert stops["name"] == "stops" and len(stops["features"]) >= 1 and {"public_id", "routes", "stop_priority"} <= set(stops["keys"])
    routes = mvt.decode_layer(one(api.route_tile(t, 9, x, y, profile="p")).tile)
    assert len(routes["features"]) == 2 and routes["extent"] == 2048
    assert mvt.decode_layer(one(api.route_tile(t, 8, x // 2, y // 2)).tile)["features"]
    assert len(mvt.decode_layer(one(api.place_tile(t["places"], 8, x // 2, y // 2)).tile)["features"]) == 2
    assert api.stop_tile(t, 9, 0, 0).count() == 0


def test_lines_are_clipped_and_simplified():
    assert mvt.simplify([(0, 0), (1, 0.01), (2, 0)], 0.1) == [(0, 0), (2, 0)] and len(mvt.simplify([(0, 0), (1, 1), (2, 0)], 0.1)) == 3
    assert mvt.clip([(-5, 5), (5, 5), (5, 15)], 0, 10) == [[(0, 5), (5, 5), (5, 10)]]
    assert mvt.clip([(-5, -5), (-1, 20)], 0, 10) == [] and len(mvt.clip([(5, 5), (15, 5), (15, 7), (5, 7)], 0, 10)) == 2
    assert mvt.encode_layer("x", [], 1, 0, 0) == b""


@given(st.integers(0, 22), st.floats(-179.9, 179.9), st.floats(-84, 84))
@settings(max_examples=60, deadline=None)
def test_tile_bounds_hold_their_points(z, lon, lat):
    size = 2 * geo.HALF_MAP / 2**z
    mx, my = math.radians(lon) * geo.MERCATOR_M, math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * geo.MERCATOR_M
    w, s, e, n = geo.tile_bounds(z, int((mx + geo.HALF_MAP) // size), int((geo.HALF_MAP - my) // size))
    assert w - 1e-3 <= mx <= e + 1e-3 and s - 1e-3 <= my <= n + 1e-3


def test_reach_of_a_feed(spark, tables):
    active = lambda offset: spark.createDataFrame([("d", "w", offset)], "date string, service_id string, day_offset int")
    walks = spark.createDataFrame([("c1", "c2", 120), ("m1", "f1", 60)], "from_stop_id string, to_stop_id string, seconds int")
    con = routing.day_connections(tables["stop_times"], tables["trips"], active(0))
    samples = spark.createDataFrame([("d", 27000), ("d", 99999)], "date string, sample int")
    got = routing.reach(samples, con, walks, ["c1"], 7200, round_to_minute=True).collect()
    assert [(r.sample, r.stop, r.seconds, r.legs) for r in got] == [(27000, "m1", 3000, 1)]  # t3 lets none alight at its second stop in time; the walk to f1 ends no way
    night = routing.day_connections(tables["stop_times"], tables["trips"], active(1))
    got = routing.reach(spark.createDataFrame([("d", 3000)], "date string, sample int"), night, walks, ["c1"], 7200)
    assert {r.stop for r in got.collect()} == {"m1"}


def stats(spark, totals, **more):
    rows = [(0, 0, t, 1, False, 60, 30, 300) for t in totals]
    df = spark.createDataFrame(rows, "requested_s int, first_departure_s int, arrival_s int, transfers int, direct boolean, initial_wait_s int, walk_s int, in_vehicle_s int").withColumn("k", F.lit(1))
    return one(metrics.travel_time_statistics(df, ["k"], **more))


def test_statistics(spark):
    r = stats(spark, [1800, 2100, 2400, 2700, 3000])
    assert (r.fastest_s, r.average_s, r.median_s, r.p90_s) == (1800, 2400, 2400, 3000)
    assert stats(spark, [1800, 2400, 3000, 3600]).median_s == 2700
    r = stats(spark, [60, None, -5])
    assert r.reachable_count == 1 and r.median_s is None and r.p90_s is None and not r.median_publishable
    assert stats(spark, [60, None, None], gate_median=False).median_s == 60
    r = stats(spark, [2400, 2700, 3000, 4200, None])
    assert r.reachable_ratio == 0.8 and r.median_s == 2850 and r.p90_s is None


@given(st.lists(st.integers(0, 99), min_size=1, max_size=12), st.sampled_from([0.1, 0.5, 0.9, 1.0]))
@settings(max_examples=6, deadline=None)
def test_nearest_rank(spark, values, q):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    assert one(df.agg(metrics.nearest_rank("v", q).alias("r"))).r == sorted(values)[math.ceil(q * len(values)) - 1]
    with pytest.raises(ValueError):
        metrics.nearest_rank("v", 0)


def test_best_and_summary(spark):
    rows = spark.createDataFrame([(0, "a", "x", 500, 2, 0), (0, "a", "y", 500, 1, 1), (600, "a", "x", 400, 1, 0), (1800, "a", "x", 900, 1, 0), (0, "b", "z", 9000, 1, 0), (0, None, "z", 9, 1, 0)], "sample int, place string, stop string, seconds int, legs int, position int")
    best = metrics.best_per_place(rows, 7200)
    assert {(r.sample, r.place, r.stop) for r in best.collect()} == {(0, "a", "x"), (600, "a", "x"), (1800, "a", "x")}
    got = {r.place: r for r in metrics.service_summary(spark.createDataFrame([("a",), ("b",)], "place string"), best, 4).collect()}
    assert (got["a"].reachable_count, got["a"].fastest_s, got["a"].max_gap, got["a"].min_transfers, got["a"].p90_s) == (3, 400, 1200, 0, None)
    assert got["a"].median_s == 500 and got["b"].reachable_count == 0 and got["b"].fastest_s is None


def test_dominance(spark):
    df = spark.createDataFrame([(1, "a", "08:10", "08:40", 0, 300), (1, "b", "08:12", "08:45", 1, 500), (1, "n", "08:20", None, 0, 0), (2, "c", "1", "1", 1, 1), (2, "d", "1", "1", 1, 1)], "g int, id string, dep string, arr string, transfers int, walk int")
    df = df.withColumns({c: F.regexp_replace(c, ":", "").cast("int") for c in ("dep", "arr")})
    keep = lambda **k: {r.id for r in routing.not_dominated(df, ["g"], "id", ["dep", "arr", "transfers", "walk"], **k).collect()}
    assert keep() == {"a", "n"} and keep(strict=True) == {"a", "n", "c", "d"}


def test_times(spark):
    v = lambda c: value(spark, c)
    assert v(times.gtfs_seconds(F.lit("25:15:00"))) == 90900 and v(times.gtfs_seconds(F.lit(""))) is None and v(times.gtfs_seconds(F.lit("08:61:00"), strict=True)) is None
    assert str(v(times.gtfs_date(F.lit("20260708")))) == "2026-07-08" and v(times.gtfs_date(F.lit("2026"))) is None
    assert len(v(times.sample_seconds(0, 28 * 3600, 300))) == 336
    assert v(times.clock_label(F.lit(90900))) == "01:15" and v(times.shift_clock(F.lit("23:50"), F.lit(20))) == "00:10"
    assert v(times.duration_label(F.lit(3900))) == "1 h 05 min" and v(times.delay_label(F.lit(-120))) == "-2 min"
    a, b = F.lit("2026-07-08T08:00:00+02:00"), F.lit("2026-07-08T08:40:00+02:00")
    assert v(times.seconds_between(a, b)) == 2400 and v(times.seconds_between(b, a)) is None and v(times.seconds_between(b, a, clamp=True)) == 0 and v(times.seconds_between(a, F.lit("x"))) is None
    assert str(v(times.local_to_utc(F.lit("2026-01-08T08:00:00")))) == "2026-01-08 07:00:00"


def test_texts(spark):
    v = lambda c: value(spark, c)
    assert v(text.german_name(F.lit("Lübeck-Hbf (tief) Straße"))) == "luebeck hauptbahnhof tief strasse"
    assert v(text.key_of(F.lit(" Größe/Élan "))) == "groe_elan" and v(text.number(F.lit("53,5"))) == 53.5
    assert v(text.dice(F.lit("a b"), F.lit("b c"))) == 0.5 and v(text.dice(F.lit("altona"), F.lit("hamburg altona"))) == 0.85 and v(text.dice(F.lit(""), F.lit(""))) == 1.0
    assert v(text.stop_numbers(F.lit("x 18002549 y 8002549 9100123"))) == ["8002549", "9100123"]
    assert v(text.html_text(F.lit("<b>A&amp;B</b>\n &uuml;ber"))) == "A&B über"
    assert v(text.location_score(F.lit(0.1), F.lit(200.0))) == 2.0 and v(text.location_score(F.lit(0.1), F.lit(300.0))) is None
    assert text.id_aliases("de:02000:18002549") == ["de:02000:18002549", "de:02000:1:8002549"] and text.csv_items(" a,,b ") == ["a", "b"]
    assert v(text.stable_id(None, F.lit("a"), F.lit("b"))) == "16d1b0f5cf3e6c5c" or len(v(text.stable_id(None, F.lit("a"), F.lit("b")))) == 16


def test_modes(spark):
    v = lambda c: value(spark, c)
    arr = lambda *m: F.array(*map(F.lit, m)).cast("array<string>")
    assert [v(modes.stop_priority(arr(*m))) for m in (["BUS", "RE"], ["U"], ["BUS", "TRAM"], ["FERRY"], [])] == ["regional", "urban_rail", "bus_only", "other", "other"]
    assert v(modes.mode_of(F.lit(None).cast("int"), F.lit("RE1"))) == "OTHER" and v(modes.mode_of(F.lit(100), F.lit("ec 5"))) == "ICE"
    assert v(modes.colour(F.lit("ff00AA"))) == "#ff00AA" and v(modes.colour(F.lit("red"))) is None
    assert v(modes.band_of(F.lit(1801))) == 45 and v(modes.in_bands(F.lit(9999), [30, 45, 60, 75, 90])) and not v(modes.in_bands(F.lit(1800), [45])) and v(modes.in_bands(F.lit(None).cast("int"), [45]))
    assert modes.modes_of_layers(["u-bahn", "bus"]) == ["U", "BUS", "TRAM"] and modes.modes_of_layers([]) == [modes.NOTHING]
    for label, want in (("Gymnasium", "gymnasium"), ("Integrierte Gesamtschule", "comprehensive"), ("Freie Waldorfschule", "waldorf"), ("Berufsbildende Schule", "vocational"), ("Gymnasiale Oberstufe", "upper_secondary"), ("Grundschule", None)):
        assert v(modes.school_category(text.key_of(F.lit(label)))) == want
    assert v(modes.school_category_of_bits(F.lit(160))) == "vocational"
    assert v(modes.line_colour(F.lit("x"), F.lit("RE"), F.lit("#123456"))) == "#123456" and v(modes.line_colour(F.lit("x"), F.lit("BUS"), F.lit("#123456"))) == "#b45309"


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "s", "a", None), (2, "s", "b", None), (3, "t", "c", None)], "id int, source string, v string, deleted_at timestamp")
    new = spark.createDataFrame([(2, "s", "B"), (4, "s", "D"), (4, "s", "E")], "id int, source string, v string")
    new = store.first_wins(new, ["id"], ["v"])
    got = {r.id: r for r in store.replace_source(old, new, ["id"], "source", F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got[1].deleted_at and not got[2].deleted_at and got[2].v == "B" and got[4].v == "D" and not got[3].deleted_at
    assert {r.id for r in store.drop_sources(old, new, "source").collect()} == {3}
    assert store.insert_new(old, new, ["id"], ["v"]).count() == 4
    control = spark.createDataFrame([("a", "active", True), ("b", "imported", False), ("c", "failed", False)], "public_id string, status string, is_active boolean")
    assert {(r.public_id, r.status) for r in store.activate(control, "b").collect()} == {("a", "archived"), ("b", "active"), ("c", "failed")}
    with pytest.raises(LookupError):
        store.activate(control, "z")
    with pytest.raises(ValueError):
        store.activate(control, "c")
    assert value(spark, store.merged_report(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))) == {"a": "1", "b": "3"}
    for v in ("x", "y"):
        store.write_snapshot({"t": spark.createDataFrame([(v,)], "v string")}, str(tmp_path), "one")
    store.write_snapshot({"t": spark.createDataFrame([("z",)], "v string")}, str(tmp_path), "two")
    assert {(r.v, r.snapshot_id) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {("y", "one"), ("z", "two")}


JOURNEY = {"refreshToken": "t", "legs": [
    {"walking": True, "departure": "2026-07-08T08:00:00+02:00", "arrival": "2026-07-08T08:05:00+02:00", "distance": 300},
    {"line": {"name": "RE1"}, "departure": "2026-07-08T08:10:00+02:00", "plannedDeparture": "2026-07-08T08:06:00+02:00", "departureDelay": 240, "plannedArrival": "2026-07-08T08:40:00+02:00", "cancelled": True, "remarks": [{"summary": "late"}, {"code": "x"}]},
    {"line": {"name": "S1"}}]}


def test_journeys(spark):
    df = spark.createDataFrame([(1, json.dumps(JOURNEY)), (2, "{"), (3, '{"legs": []}')], "id int, j string")
    r = {x.id: x for x in journeys.itineraries(df, "j", F.lit("2026-07-08T07:54:00+02:00")).collect()}
    assert (r[1].duration_s, r[1].initial_wait_s, r[1].transfers, r[1].in_vehicle_s, r[1].walk_s, r[1].walk_m) == (2400, 360, 0, 1800, 300, 300.0)
    assert r[1].cancelled and r[1].remarks == ["late", "x"] and r[3].in_vehicle_s is None and r[3].duration_s is None
    kinds = journeys.ranked(spark.createDataFrame([(1, "a", "3", 0), (1, "b", "2", 1)], "g int, departure_at string, arrival_at string, transfers int"), ["g"]).collect()
    assert {(k.departure_at, k.kind) for k in kinds} == {("b", "earliest_arrival"), ("a", "fewest_transfers")}
    wanted = spark.createDataFrame([(1, "Hamburg Hbf", 53.55, 10.0)], "request int, name string, lat double, lon double")
    offers = spark.createDataFrame([(1, 0, "x", "Bremen Hbf", 53.08, 8.81, None), (1, 1, "y", "Hamburg Hauptbahnhof", 53.55, 10.0, None), (1, 2, "z", "Hamburg Hauptbahnhof", 53.55, 10.0, None)], "request int, position int, id string, name string, lat double, lon double, distance double")
    assert one(journeys.match_places(wanted, offers)).id == "y"


def test_rail(spark):
    pt = lambda *p: [{"lon": x, "lat": y} for x, y in p]
    ways = spark.createDataFrame([(1, {"railway": "rail"}, pt((10.0, 53.0), (10.1, 53.0))), (2, {"railway": "rail"}, pt((10.1, 53.0), (10.2, 53.0))), (3, {"railway": "rail", "service": "yard"}, pt((10.0, 53.0), (10.2, 53.0))), (4, {"railway": "rail", "disused": "yes"}, pt((0.0, 0.0), (1.0, 0.0))), (5, {"railway": "tram"}, pt((12.0, 53.0), (12.1, 53.0))), (6, {"highway": "x"}, pt((1.0, 1.0), (2.0, 2.0)))], "id int, tags map<string,string>, line array<struct<lon:double,lat:double>>")
    edges = stored(rail.rail_edges(rail.rail_ways(ways)))
    assert edges.count() == 4
    labels = rail.components(edges, stored)
    assert {r.component for r in labels.collect()} == {"10.0:53.0", "12.0:53.0"}
    pairs = spark.createDataFrame([("10.0:53.0", "10.2:53.0"), ("10.0:53.0", "12.0:53.0")], "source string, target string")
    assert [r.edge_id for r in rail.shortest_paths(edges, pairs, labels).orderBy("step").collect()] == ["1", "2"]
    stops = spark.createDataFrame([("s", 10.001, 53.001)], "public_id string, lon double, lat double")
    snaps = rail.snap_stops(stops, edges).orderBy("rank").collect()
    assert [r.edge_id for r in snaps] == [1, 3] and snaps[0].vertex == "10.0:53.0" and snaps[0].distance_m == pytest.approx(111.2, abs=0.5)
    v = lambda c: value(spark, c)
    score = lambda *a: v(F.round(rail.confidence(*(F.lit(x).cast("double") if not isinstance(x, bool) else F.lit(x) for x in a)), 4))
    assert score(0.0, 0.0, 4.0, 1.0, False, 0.0) == 1.0 and score(None, 0.0, 0.0, None, True, 9999.0) == 0.0 and score(400.0, 1.0, 4.0, 1.0, False, 500.0) == round(1 - 0.125 - 0.1125 - 0.1, 4)


def test_points_of_interest(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"schul_id": "7", "schulname": "Gymnasium Nord", "schulform": "Gymnasium", "adresse": "Weg 1"}, "geometry": {"type": "Point", "coordinates": [10, 53.5]}}, {"properties": {"schulname": "Grundschule"}, "geometry": {"type": "Point", "coordinates": [10, 53.5]}}]}))
    (tmp_path / "b.csv").write_text("source_place_id;name;bundesland;lat;lon\n1;Hof A;Schleswig-Holstein;53,5;10,1\n1;Hof B;SH;53,5;10,1\n2;;SH;1;1\n")
    r = one(poi.schools(files.read_any(spark, str(tmp_path / "a.geojson"), False), "schools_hh", "HH"))
    assert (r.source_school_id, r.school_category, r.lon) == ("7", "gymnasium", 10.0)
    r = one(poi.places(files.read_any(spark, str(tmp_path / "b.csv")), "x", "hof"))
    assert (r.name, r.state_code, r.lat) == ("Hof A", "SH", 53.5)
    with pytest.raises(ValueError):
        files.read_any(spark, "x.xyz")
    page = """<a class="x teaser-card-href" href="/hof/hof-sonne-12" id="12">t</a><a href="/a/hofdetails/ukv/house/mond-9"> <b>Hof &amp; Mond</b></a>
      <h2>Titel</h2><a href="/z">z</a><i data-facility-id="77"></i><script type="application/ld+json">{"@graph": [{"@type": ["Hotel"], "name": "N", "address": {"streetAddress": "S 1"}, "geo": {"latitude": "53,5", "longitude": 10}}]}</script><script type="application/ld+json">{bad</script>"""
    pages = spark.createDataFrame([("u", page), ("v", None)], "url string, html string")
    assert [(r.external_id, r.name) for r in poi.listing_links(pages, "teaser").collect()] == [("12", "hof sonne")]
    assert [(r.external_id, r.name) for r in poi.listing_links(pages, "house").collect()] == [("mond-9", "Hof & Mond")]
    assert [(r.external_id, r.name, r.href) for r in poi.facility_listing(pages).collect()][0][:2] == ("77", "Titel")
    d = research.structured_data(pages).collect()
    assert [(r.name, r.address, r.lon, r.lat) for r in d] == [("N", "S 1", 10.0, 53.5)]
    cand = spark.createDataFrame([("1", "Hof X", "A", None, None, None, "SH", "listing_link", "u"), ("2", "hof x", "a", "w", 10.0, 53.0, "SH", "listing_link", None)], "pos string, name string, address string, website string, lon double, lat double, state_code string, confidence string, detail_url string")
    assert one(poi.dedupe_best(cand, "pos")).pos == "2"


def test_streams(spark, tmp_path):
    from tramline.streaming import samples

    rows = spark.createDataFrame([("a", "2026-01-01 08:00:10", 5), ("a", "2026-01-01 08:00:20", 3), ("a", "2026-01-01 08:07:00", 9)], "k string, at string, v int").withColumn("at", F.col("at").cast("timestamp"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = samples.run_once(samples.by_window(stream, ["k"], "at", "v"), "w", f"{tmp_path}/c1", "complete").collect()
    assert sorted((r.n, r.least, r.most) for r in got) == [(1, 9, 9), (2, 3, 5)]
    got = samples.run_once(samples.fresh(stream, ["k"], "at"), "f", f"{tmp_path}/c2").collect()
    assert len(got) >= 1


def test_registry(spark, tmp_path):
    from tramline.sources import registry

    path = str(tmp_path / "m" / "manifest.json")
    m = registry.read_manifest(path)
    for key in ("b", "a", "b"):
        m = registry.upsert_source(m, {"source_key": key, "format": "zip", "sha256": key * 2})
    registry.write_manifest(path, m)
    m = registry.read_manifest(path)
    assert [s["source_key"] for s in m["sources"]] == ["a", "b"] and m["generated_at"]
    assert registry.source_metadata(m, "b")["sha256"] == "bb" and registry.source_metadata(m, "c") == {}
    assert registry.manifest_table(spark, m).count() == 2
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        for name, body in FEED.items():
            z.writestr(f"{name}.txt", body)
    good = registry.check_file(str(tmp_path / "f.zip"), "gtfs", "0" * 32)
    assert good["validation_status"] == "warning" and good["sha256"] == registry.digest(str(tmp_path / "f.zip"))
    (tmp_path / "page").write_text("<html>")
    for kind in ("zip", "osm.pbf"):
        with pytest.raises(ValueError):
            registry.check_file(str(tmp_path / "page"), kind)
    with pytest.raises(ValueError):
        registry.check_file(str(tmp_path / "f.zip"), "boundaries")
    assert registry.choose_layer([("vg250_krs", "features"), ("vg250_lan", "features")]) == "vg250_lan" and registry.choose_layer([("x", "tiles"), ("y", "features")]) == "y"
    with pytest.raises(FileNotFoundError):
        registry.validate_sources(str(tmp_path / "none"))


def test_boundaries_and_states(spark, tmp_path):
    from tramline.sources import registry

    square = lambda x: [[[x, 53.0], [x + 1, 53.0], [x + 1, 54.0], [x, 54.0], [x, 53.0]]]
    features = [
        {"properties": {"GEN": "Schleswig-Holstein", "AGS": "01"}, "geometry": {"type": "MultiPolygon", "coordinates": [square(9), square(12)]}},
        {"properties": {"GEN": "Hamburg"}, "geometry": {"type": "Polygon", "coordinates": square(10)}},
        {"properties": {"GEN": "Bayern", "AGS": "09"}, "geometry": {"type": "Polygon", "coordinates": square(11)}},
        {"properties": {"GEN": "Bremen"}, "geometry": {"type": "Point", "coordinates": [9, 53]}},
    ]
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    states = registry.dissolve(registry.boundaries(spark, str(tmp_path / "b.geojson")))
    assert {r.state_code: len(r.rings) for r in states.collect()} == {"DE-SH": 2, "DE-HH": 1}
    points = spark.createDataFrame([("a", 9.5, 53.5), ("b", 12.5, 53.5), ("c", 10.5, 53.5), ("d", 11.5, 53.5), ("e", None, 53.5)], "id string, lon double, lat double")
    assert {r.id: r.state_code for r in poi.states_of_points(points, states).collect()} == {"a": "DE-SH", "b": "DE-SH", "c": "DE-HH", "d": None, "e": None}


def test_rail_matching(spark):
    pts = lambda *p: [(float(x), float(y)) for x, y in p]
    ways = spark.createDataFrame(
        [(1, {"railway": "rail"}, pts((10, 53), (10.1, 53))), (2, {"railway": "rail"}, pts((10.1, 53), (10.2, 53))), (3, {"railway": "rail", "disused": "yes"}, pts((10.2, 53), (10.3, 53)))],
        "id long, tags map<string,string>, line array<struct<lon:double,lat:double>>",
    )
    edges = stored(rail.rail_edges(rail.rail_ways(ways)))
    assert edges.count() == 2 and rail.rail_vertices(edges).count() == 3
    stops = spark.createDataFrame([("a", 10.0, 53.0005), ("b", 10.14, 53.0005), ("c", 10.2, 53.0), ("far", 11.0, 53.0)], "public_id string, lon double, lat double")
    snaps = stored(rail.snap_stops(stops, edges))
    middle = [r for r in snaps.collect() if r.public_id == "b"][0]
    assert middle.edge_id == 2 and middle.distance_m == pytest.approx(55.6, abs=0.5)  # beside the middle of a long step
    calls = spark.createDataFrame([("p", 1, "a"), ("p", 2, "c"), ("q", 1, "a"), ("q", 2, "far")], "pattern_id string, stop_sequence int, stop_place_id string")
    patterns = spark.createDataFrame([("p", pts((10, 53), (10.2, 53))), ("q", None)], "pattern_id string, line array<struct<lon:double,lat:double>>")
    got = {r.pattern_id: r for r in rail.match_patterns(patterns, calls, stops, snaps, edges, stored).collect()}
    assert got["p"].status == "osm_reconstructed" and len(got["p"].lines) == 2 and got["p"].detour == pytest.approx(1.0, abs=0.01)
    assert got["q"].status == "fallback" and got["q"].failed_segments == 1 and got["q"].lines is None
    with pytest.raises(ValueError):
        rail.box_of("1,2,3,4", "hamburg-kiel")


def test_research_collects(spark):
    pages = spark.createDataFrame([("landsichten_sh_kinderhof", "https://x.example/schleswig-holstein", '<a class="teaser-card-href" href="/d/1" id="1">', None), ("landreise_ni", "https://x.example/m", None, "timeout")], "source_id string, url string, html string, error string")
    body = '<script type="application/ld+json">{"@type":"Hotel","name":"Hof &amp; Gut","geo":{"latitude":54,"longitude":10}}</script>'
    details = spark.createDataFrame([("https://x.example/d/1", body, None)], "url string, html string, error string")
    none = spark.createDataFrame([], "record string")
    every, best = research.collect(pages, none, none, details)
    assert {r.confidence for r in every.collect()} == {"structured_detail", "fetch_error"}
    rows = research.importable(best).collect()
    assert [(r.name, r.lat, r.state_code) for r in rows] == [("Hof & Gut", 54.0, "SH")]


def test_requests_are_checked(spark):
    assert api.checked_request({"z": "3", "x": "1", "y": "2"})["z"] == 3 and api.checked_request({})["limit"] == 20
    for bad in ({"limit": 51}, {"z": 23}, {"date": "8.7.2026"}, {"time": "25:00"}, {"z": 1, "x": 2}):
        with pytest.raises(ValueError):
            api.checked_request(bad)


def test_fixture_answers(spark):
    from tramline.plans.fixture import fixture

    t = fixture(spark)
    assert [r.public_id for r in api.search_stops(t, "busdorf", ["DE-SH"], ["BUS"]).collect()] == ["de:01056:9100"]
    assert one(api.stop_metrics(t, "de:02000:8002550", "regular_tue_thu")).fastest_s == 1500
    assert one(api.list_places(t, "testfeld")).name == "Gut Testfeld"

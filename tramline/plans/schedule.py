"""Queries over a feed made of the test tables, run through the import, with their DuckDB SQL.

Suppliers are the feed's stops (every tenth a station, the three after it its
platforms), nations its agencies, parts its routes, orders its trips, line
items its stop times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators import normalise, rail
from tramline.plans import api
from tramline.plans.catalog import TIMES, places, query, stop_times, table

LON, LAT = "6.5 + (s_suppkey * 37 % 800) / 100.0::DOUBLE", "52.0 + (s_suppkey * 53 % 300) / 100.0::DOUBLE"
#: The feed in SQL: stops, stations with their places, technical stops, routes, trips and stop times.
FEED = f"""{TIMES},
stops AS (SELECT s_suppkey AS k, 's' || s_suppkey AS stop_id, s_name AS name, {LON} AS lon, {LAT} AS lat, s_suppkey % 10 = 0 AS station, CASE WHEN s_suppkey % 10 BETWEEN 1 AND 3 THEN 's' || (s_suppkey - s_suppkey % 10) END AS parent FROM supplier),
stations AS (SELECT * FROM stops WHERE station OR parent IS NULL OR parent NOT IN (SELECT stop_id FROM stops WHERE station)),
technical AS (SELECT k, stop_id, coalesce(parent, stop_id) AS place FROM stops WHERE coalesce(parent, stop_id) IN (SELECT stop_id FROM stations)),
rt AS (SELECT 'p' || p_partkey AS route_id, p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS short_name, p_name AS long_name, CASE WHEN p_partkey % 4 < 3 THEN '#' || upper(substr(md5(p_name), 1, 6)) END AS color, p_size % 30 AS agency, (p_size * 37) % 1700 AS t FROM part),
routes AS (SELECT *, CASE WHEN t = 0 OR t BETWEEN 900 AND 999 THEN 'TRAM' WHEN t = 1 OR t BETWEEN 400 AND 405 THEN 'U' WHEN t = 2 OR t BETWEEN 100 AND 199 THEN 'RAIL' WHEN t = 3 OR t BETWEEN 700 AND 799 THEN 'BUS' WHEN t = 4 OR t = 1000 THEN 'FERRY' WHEN t BETWEEN 1500 AND 1599 THEN 'TAXI' ELSE 'OTHER' END AS mode FROM rt),
trips AS (SELECT trip_id, 'p' || min(route) AS route_id, trip_id % 2 AS direction FROM times GROUP BY trip_id),
calls AS (SELECT times.*, technical.stop_id, technical.place FROM times JOIN technical ON technical.k = times.stop),
signed AS (SELECT trip_id, string_agg(stop_id || ':' || coalesce(CAST(pickup_type AS VARCHAR), '') || ':' || coalesce(CAST(drop_off_type AS VARCHAR), ''), '>' ORDER BY stop_sequence) AS signature FROM calls GROUP BY trip_id),
patterns AS (SELECT sha256(route_id || '|' || direction || '||' || md5(signature)) AS pattern_id, route_id, min(CAST(trip_id AS VARCHAR)) AS representative, count(*) AS trips FROM trips JOIN signed USING (trip_id) GROUP BY route_id, direction, signature),
pattern_calls AS (SELECT pattern_id, route_id, stop_sequence, stop_id, place FROM patterns JOIN calls ON CAST(calls.trip_id AS VARCHAR) = representative)"""


def feed(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Staging tables, all text, as read from a feed."""
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    halts = places(spark, d, "supplier")
    k = F.col("s_suppkey")
    parent = F.when((k % 10).between(1, 3), F.concat(F.lit("s"), k - k % 10)).otherwise("")
    stops = halts.select(F.concat(F.lit("s"), k).alias("stop_id"), F.col("s_name").alias("stop_name"), text("lat").alias("stop_lat"), text("lon").alias("stop_lon"), F.when(k % 10 == 0, "1").otherwise("0").alias("location_type"), parent.alias("parent_station"), F.lit("").alias("platform_code"))
    p = F.col("p_partkey")
    colour = F.when(p % 4 < 3, F.upper(F.substring(F.md5(F.col("p_name").cast("binary")), 1, 6))).otherwise("")
    lines = table(spark, d, "part").select(F.concat(F.lit("p"), p).alias("route_id"), text(F.col("p_size") % 30).alias("agency_id"), F.when(p % 3 > 0, F.col("p_brand")).otherwise("").alias("route_short_name"), F.col("p_name").alias("route_long_name"), text(F.col("p_size") * 37 % 1700).alias("route_type"), colour.alias("route_color"))
    times = stop_times(spark, d)
    clock = lambda c: F.format_string("%d:%02d:%02d", (F.col(c) / 3600).cast("int"), (F.col(c) % 3600 / 60).cast("int"), F.col(c) % 60)
    calls = times.select(text("trip_id").alias("trip_id"), clock("arrival_s").alias("arrival_time"), clock("departure_s").alias("departure_time"), F.concat(F.lit("s"), "stop").alias("stop_id"), text("stop_sequence").alias("stop_sequence"), text("pickup_type").alias("pickup_type"), text("drop_off_type").alias("drop_off_type"))
    trips = times.groupBy("trip_id").agg(F.min("route").alias("r")).select(F.concat(F.lit("p"), "r").alias("route_id"), F.concat(F.lit("c"), F.col("trip_id") % 7).alias("service_id"), text("trip_id").alias("trip_id"), text(F.col("trip_id") % 2).alias("direction_id"), F.lit("").alias("shape_id"))
    agency = table(spark, d, "nation").select(text("n_nationkey").alias("agency_id"), F.col("n_name").alias("agency_name"), F.lit("").alias("agency_url"), F.lit("Europe/Berlin").alias("agency_timezone"))
    empty = lambda names: spark.createDataFrame([], ", ".join(f"{n} string" for n in names.split()))
    return {
        "agency": agency,
        "stops": stops,
        "routes": lines,
        "trips": trips,
        "stop_times": calls,
        "calendar": empty("service_id monday tuesday wednesday thursday friday saturday sunday start_date end_date"),
        "calendar_dates": empty("service_id date exception_type"),
        "shapes": empty("shape_id shape_pt_lat shape_pt_lon shape_pt_sequence shape_dist_traveled"),
        "transfers": empty("from_stop_id to_stop_id transfer_type min_transfer_time"),
        "feed_info": empty("feed_publisher_name feed_version"),
    }


def imported(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return normalise.normalise(feed(spark, d))


@query(f"WITH {FEED} SELECT stop_id AS public_id, lower(regexp_replace(name, '\\s+', ' ', 'g')) AS normalized_name, round(lon, 6) AS lon, round(lat, 6) AS lat, 'missing_dhid' AS identity_quality FROM stations")
def feed_places(spark, d):
    """Places of the feed: stations, and stops whose station is missing."""
    return imported(spark, d)["stop_places"].select("public_id", "normalized_name", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "identity_quality")


@query(f"WITH {FEED} SELECT stop_id, place AS stop_place_id FROM technical")
def feed_stops(spark, d):
    """Technical stops with their place; a child of a missing station has none and is left out."""
    return imported(spark, d)["stops"].select("stop_id", "stop_place_id")


@query(f"WITH {FEED} SELECT route_id, short_name, mode, substr(color, 2) AS color, n_name AS agency_name FROM routes LEFT JOIN nation ON n_nationkey = agency")
def feed_routes(spark, d):
    """Routes with mode and operator; an unknown operator is null."""
    return imported(spark, d)["routes"].select("route_id", "short_name", "mode", "color", "agency_name")


@query(f"WITH {FEED} SELECT place AS stop_place_id, count(*) AS calls, sum(arrival_s)::BIGINT AS arrivals, count(DISTINCT trip_id) AS trips FROM calls GROUP BY place")
def feed_calls(spark, d):
    """Typed stop times per place, those of unknown stops dropped."""
    t = imported(spark, d)["stop_times"]
    return t.groupBy("stop_place_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("arrival_s").cast("long")).alias("arrivals"), F.count_distinct("trip_id").alias("trips"))


@query(f"WITH {FEED} SELECT pattern_id, route_id, representative, trips FROM patterns")
def feed_patterns(spark, d):
    """Patterns: trips of one route and direction with one stop sequence."""
    t = imported(spark, d)
    of_trip = t["trips"].where("pattern_id is not null").groupBy("pattern_id").agg(F.min("trip_id").alias("representative"), F.count(F.lit(1)).alias("trips"))
    return t["route_patterns"].select("pattern_id", "route_id").join(of_trip, "pattern_id")


DISTANCE = "2 * 6371008.8 * asin(least(sqrt(power(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * power(sin(radians({b}lon - {a}lon) / 2), 2)), 1))"


@query(f"""WITH {FEED}, n AS (SELECT route_id, place, lead(place) OVER (PARTITION BY pattern_id ORDER BY stop_sequence) AS nxt FROM pattern_calls),
pairs AS (SELECT DISTINCT route_id, least(place, nxt) AS from_id, greatest(place, nxt) AS to_id FROM n WHERE nxt IS NOT NULL AND nxt <> place)
SELECT route_id, from_id, to_id, round({DISTANCE.format(a='a.', b='b.')}, 3) AS length_m FROM pairs JOIN stations a ON a.stop_id = from_id JOIN stations b ON b.stop_id = to_id""")
def feed_segments(spark, d):
    """Stop pairs of each route with their straight length."""
    return imported(spark, d)["route_stop_segments"].select("route_id", "from_id", "to_id", F.round("length_m", 3).alias("length_m"))


@query(f"""WITH {FEED}, m AS (SELECT place, list_sort(list(DISTINCT mode)) AS modes FROM pattern_calls JOIN routes USING (route_id) GROUP BY place)
SELECT stop_id AS public_id, coalesce(array_to_string(modes, ','), '') AS modes FROM stations LEFT JOIN m ON place = stop_id""")
def feed_modes(spark, d):
    """Modes that serve each place, none for places never served."""
    return imported(spark, d)["stop_places"].select("public_id", F.array_join("modes", ",").alias("modes"))


@query(f"""WITH {FEED}, p AS (SELECT pattern_id, stop_sequence, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM pattern_calls JOIN stations ON stations.stop_id = place WINDOW w AS (PARTITION BY pattern_id ORDER BY stop_sequence)),
s AS (SELECT pattern_id, count(*) AS points, sum(CASE WHEN lat2 IS NOT NULL THEN 2 * 6371008.8 * asin(least(sqrt(power(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon) / 2), 2)), 1)) END) AS length_m FROM p GROUP BY pattern_id)
SELECT pattern_id, CASE WHEN points >= 2 THEN 'stop_sequence_approximation' END AS geometry_quality, CASE WHEN points >= 2 THEN round(length_m, 2) END AS length_m, CASE WHEN points >= 2 THEN CAST(points AS INTEGER) END AS points FROM s""")
def feed_lines(spark, d):
    """Lines of patterns through their places, with quality and length; none below two points."""
    return imported(spark, d)["route_patterns"].select("pattern_id", "geometry_quality", F.round("length_m", 2).alias("length_m"), F.when(F.col("line").isNotNull(), F.size("line")).alias("points"))


def _tables(spark, d) -> api.Tables:
    t = imported(spark, d)
    snapshot = lambda df: df.withColumn("snapshot_id", F.lit("now"))
    frames = {k: snapshot(v) for k, v in t.items()}
    frames["snapshots"] = spark.createDataFrame([("now", True, "imported", "src"), ("old", False, "archived", "src")], "public_id string, is_active boolean, status string, source_key string")
    return api.Tables(frames)


@query(f"""WITH {FEED}, served AS (SELECT DISTINCT route_id FROM pattern_calls WHERE place = 's20'),
r AS (SELECT routes.*, n_name FROM served JOIN routes USING (route_id) LEFT JOIN nation ON n_nationkey = agency ORDER BY short_name NULLS LAST, long_name NULLS LAST, route_id LIMIT 100)
SELECT route_id, short_name, long_name, mode, color, n_name AS agency_name FROM r""")
def stop_details(spark, d):
    """Routes of one stop with their operators, unnamed last, a hundred at most."""
    found = api.stop_details(_tables(spark, d), "s20").select(F.explode("routes").alias("r"))
    return found.select("r.route_id", "r.short_name", "r.long_name", "r.mode", "r.color", "r.agency_name")


@query(f"""WITH {FEED}, one AS (SELECT * FROM patterns ORDER BY pattern_id LIMIT 1)
SELECT one.pattern_id, trips AS trip_count, mode, n_name AS agency_name, (SELECT count(*) FROM pattern_calls c JOIN stations ON stations.stop_id = place WHERE c.pattern_id = one.pattern_id) AS stops FROM one JOIN routes USING (route_id) LEFT JOIN nation ON n_nationkey = agency""")
def pattern_detail(spark, d):
    """One pattern with its trips, operator and stops."""
    t = _tables(spark, d)
    first = t["route_patterns"].agg(F.min("pattern_id")).first()[0]
    return api.route_pattern(t, first).select("pattern_id", "trip_count", "mode", "agency_name", F.size("stops").cast("long").alias("stops"))


@query(f"""WITH {FEED}, o AS (SELECT trip_id, min(stop_sequence) AS b FROM calls WHERE place = 's20' AND coalesce(pickup_type, 0) <> 1 GROUP BY trip_id)
SELECT place AS destination, count(DISTINCT calls.trip_id) AS trips FROM calls JOIN o ON o.trip_id = calls.trip_id AND stop_sequence > b WHERE coalesce(drop_off_type, 0) <> 1 AND calls.trip_id % 7 IN (0, 3) GROUP BY place""")
def direct_trips_of_day(spark, d):
    """Direct trips from one place on one service day."""
    t = _tables(spark, d)
    days = spark.createDataFrame([("c0", True), ("c3", True), ("c4", False)], "service_id string, is_active boolean").withColumn("service_date", F.lit("2026-07-08").cast("date"))
    t.frames["service_dates"] = days.withColumn("snapshot_id", F.lit("now"))
    return api.direct_trips(t, "s20", "2026-07-08")


@query(f"""WITH {FEED} SELECT stop_id AS public_id, name FROM stations WHERE name ILIKE '%0_2%' OR stop_id ILIKE '%0_2%' ORDER BY name, stop_id LIMIT 20""")
def search_stops(spark, d):
    """Display stops whose name or id fits, by name."""
    return api.search_stops(_tables(spark, d), "0_2").select("public_id", "name")


# --- rails -----------------------------------------------------------------------


#: A grid of tracks: edge e from node (x, y) to the next one east or north, over the area of the places.
GRID = "g AS (SELECT x, y, 6.5::DOUBLE + x * 0.4::DOUBLE AS lon, 52.0::DOUBLE + y * 0.25::DOUBLE AS lat FROM range(21) a(x), range(13) b(y))"


def tracks(spark: SparkSession) -> DataFrame:
    x = spark.range(21).select(F.col("id").alias("x"))
    nodes = x.select("x", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("y"))
    at = lambda dx, dy: F.struct((6.5 + (F.col("x") + dx) * F.lit(0.4)).alias("lon"), (52.0 + (F.col("y") + dy) * F.lit(0.25)).alias("lat"))
    east = nodes.where("x < 20").select(F.concat_ws("-", F.lit("e"), "x", "y").alias("id"), F.array(at(0, 0), at(1, 0)).alias("line"))
    north = nodes.where("y < 12").select(F.concat_ws("-", F.lit("n"), "x", "y").alias("id"), F.array(at(0, 0), at(0, 1)).alias("line"))
    tags = F.when(F.col("id").endswith("7"), F.create_map(F.lit("railway"), F.lit("rail"), F.lit("service"), F.lit("yard"))).otherwise(F.create_map(F.lit("railway"), F.lit("rail")))
    return rail.rail_edges(rail.rail_ways(east.unionByName(north).withColumn("tags", tags)))


EDGES = f"""{GRID}, e AS (SELECT 'e-' || a.x || '-' || a.y AS id, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2 FROM g a JOIN g b ON b.x = a.x + 1 AND b.y = a.y
  UNION ALL SELECT 'n-' || a.x || '-' || a.y, a.lon, a.lat, b.lon, b.lat FROM g a JOIN g b ON b.x = a.x AND b.y = a.y + 1),
edges AS (SELECT *, 2 * 6371008.8 * asin(least(sqrt(power(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * power(sin(radians(x2 - x1) / 2), 2)), 1)) AS length_m, right(id, 1) = '7' AS is_service FROM e)"""


@query(f"""WITH {EDGES}, p AS (SELECT s_suppkey AS stop, {LON} AS lon, {LAT} AS lat FROM supplier),
j AS (SELECT stop, id, is_service, lon, lat, x1 + (x2 - x1) * t AS px, y1 + (y2 - y1) * t AS py FROM (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, ((lon - x1) * cos(radians(lat)) * (x2 - x1) * cos(radians(lat)) + (lat - y1) * (y2 - y1)) / (power((x2 - x1) * cos(radians(lat)), 2) + power(y2 - y1, 2)))) AS t
  FROM p JOIN edges ON lon BETWEEN least(x1, x2) - 0.1 AND greatest(x1, x2) + 0.1 AND lat BETWEEN least(y1, y2) - 0.1 AND greatest(y1, y2) + 0.1)),
m AS (SELECT *, 2 * 6371008.8 * asin(least(sqrt(power(sin(radians(py - lat) / 2), 2) + cos(radians(lat)) * cos(radians(py)) * power(sin(radians(px - lon) / 2), 2)), 1)) AS m FROM j WHERE sqrt(power(px - lon, 2) + power(py - lat, 2)) <= 0.1),
r AS (SELECT *, row_number() OVER (PARTITION BY stop ORDER BY round(m, 2), is_service, id) AS rank FROM m WHERE m <= 5000)
SELECT stop, count(*) AS found, min(round(m, 2)) AS nearest_m FROM r WHERE rank <= 3 GROUP BY stop""")
def segment_snap(spark, d):
    """Stops snapped to the nearest points of tracks within reach."""
    stops = places(spark, d, "supplier").select(F.col("s_suppkey").alias("public_id"), "lon", "lat")
    found = rail.snap_stops(stops, tracks(spark), 5000.0, 0.1)
    return found.groupBy(F.col("public_id").alias("stop")).agg(F.count(F.lit(1)).alias("found"), F.min(F.round("distance_m", 2)).alias("nearest_m"))


MATCH = """v AS (SELECT l_orderkey AS pattern_id, l_linenumber AS stop_sequence, CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 40 END AS vertex, CASE WHEN l_suppkey % 5 > 0 THEN CAST(l_suppkey % 700 AS DOUBLE) END AS distance_m FROM st),
seg AS (SELECT *, lead(vertex) OVER (PARTITION BY pattern_id ORDER BY stop_sequence) AS target, lead(stop_sequence) OVER (PARTITION BY pattern_id ORDER BY stop_sequence) AS nxt FROM v),
seg2 AS (SELECT pattern_id, stop_sequence, vertex AS source, target, distance_m, (vertex IS NOT NULL AND target IS NOT NULL AND vertex <> target AND (vertex + target) % 3 > 0) AS routed FROM seg WHERE nxt IS NOT NULL)"""


def _match_input(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Stops of patterns, snaps, places, and the segments for which a way is taken as found."""
    t = stop_times(spark, d)
    calls = t.select(F.col("trip_id").alias("pattern_id"), "stop_sequence", F.col("stop").alias("stop_place_id"))
    stops = places(spark, d, "supplier").select(F.col("s_suppkey").alias("public_id"), "lon", "lat")
    k = F.col("public_id")
    snaps = stops.where(k % 5 > 0).select("public_id", (k % 40).alias("vertex"), (k % 700).cast("double").alias("distance_m"), F.lit(1).alias("rank"))
    segments = rail.pattern_segments(calls, snaps, stops)
    routed = segments.where("source is not null and target is not null and source != target and (source + target) % 3 > 0")
    return segments, routed, snaps, stops


ST_ONLY = TIMES.split(", times AS")[0]


@query(f"""WITH {ST_ONLY}, {MATCH} SELECT pattern_id, count(*) AS total_segments, count(*) FILTER (WHERE source IS NULL OR target IS NULL) AS unsnapped_segments, count(*) FILTER (WHERE source IS NOT NULL AND target IS NOT NULL AND source <> target AND NOT routed) AS unrouted_segments,
  round(avg(distance_m), 6) AS mean_snap_m, max(distance_m) AS max_snap_m FROM seg2 GROUP BY pattern_id""")
def pattern_match_stats(spark, d):
    """Per pattern: segments, those without a snap or a way, and snap distances."""
    segments, routed, _, _ = _match_input(spark, d)
    out = rail.match_statistics(segments, routed)
    return out.select("pattern_id", "total_segments", "unsnapped_segments", "unrouted_segments", F.round("mean_snap_m", 6).alias("mean_snap_m"), "max_snap_m")


@query(f"""WITH {ST_ONLY}, {MATCH}, paths AS (SELECT pattern_id, stop_sequence, CAST(source * 10 + target AS DOUBLE) AS length_m, source % 7 = 0 AS is_service FROM seg2 WHERE routed)
SELECT pattern_id, sum(length_m) AS routed_m, bool_or(is_service) AS uses_service, CAST(count(*) AS INTEGER) AS lines, arg_min(length_m, stop_sequence) AS first_m FROM paths GROUP BY pattern_id""")
def match_collect(spark, d):
    """Ways of a pattern collected in order, with length and use of service tracks."""
    _, routed, _, _ = _match_input(spark, d)
    length = (F.col("source") * 10 + F.col("target")).cast("double")
    paths = routed.select("pattern_id", "stop_sequence", F.lit(0).alias("step"), F.array(F.struct(length.alias("lon"), F.lit(0.0).alias("lat"))).alias("line"), length.alias("length_m"), (F.col("source") % 7 == 0).alias("is_service"))
    out = rail.match_lines(paths)
    return out.select("pattern_id", "routed_m", "uses_service", F.size("lines").alias("lines"), F.element_at("lines", 1)[0]["lon"].alias("first_m"))


@query(f"""WITH {EDGES}, m AS (SELECT p_partkey % 3 AS s FROM part)
SELECT (SELECT count(*) FROM g) AS rail_vertices, (SELECT count(*) FROM edges) AS rail_edges, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 1) AS snapped_stops,
  (SELECT count(*) FROM m WHERE s = 0) AS reconstructed_patterns, (SELECT count(*) FROM m WHERE s = 1) AS low_confidence_patterns, (SELECT count(*) FROM m WHERE s = 2) AS fallback_patterns""")
def rail_summary(spark, d):
    """Counts over vertices, edges, snaps and matches in one row."""
    e = tracks(spark)
    status = F.element_at(F.array(F.lit("osm_reconstructed"), F.lit("osm_reconstructed_low_confidence"), F.lit("fallback")), (F.col("p_partkey") % 3 + 1).cast("int"))
    snaps = table(spark, d, "supplier").select((F.col("s_suppkey") % 3).alias("rank"))
    return rail.summary(e, rail.rail_vertices(e), snaps, table(spark, d, "part").select(status.alias("status")))


@query("""WITH a AS (SELECT c_custkey, (c_custkey * 37 % 800) / 100.0::DOUBLE + 6.5 AS lon, (c_custkey * 53 % 300) / 100.0::DOUBLE + 52 AS lat FROM customer)
SELECT c_custkey, round(sqrt(power(radians(0.01::DOUBLE) * 6378137.0, 2) + power((ln(tan(pi() / 4 + radians(lat + 0.01) / 2)) - ln(tan(pi() / 4 + radians(lat) / 2))) * 6378137.0, 2)), 3) AS apart FROM a""")
def line_distance(spark, d):
    """Hausdorff distance on the map of a place's line and the same line moved."""
    at = lambda m: F.array(F.struct((F.col("lon") + m).alias("lon"), (F.col("lat") + m).alias("lat")))
    return places(spark, d).select("c_custkey", F.round(rail.hausdorff(at(F.lit(0.0)), at(F.lit(0.01))), 3).alias("apart"))


@query("""SELECT c_custkey, '{"type":"LineString","coordinates":[[' || (c_custkey % 90) || '.5,' || (c_custkey % 45) || '.25],[' || (c_custkey % 90) || '.75,' || (c_custkey % 45) || '.5]]}' AS geojson FROM customer""")
def line_geojson(spark, d):
    """A line as GeoJSON text."""
    k = F.col("c_custkey")
    at = lambda a, b: F.struct((k % 90 + a).alias("lon"), (k % 45 + b).alias("lat"))
    return table(spark, d, "customer").select("c_custkey", geo.geojson_line(F.array(at(0.5, 0.25), at(0.75, 0.5))).alias("geojson"))

"""Queries over map extracts, lines and areas made of the test tables: suppliers and customers are nodes, orders ways, nations areas."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions import geo, geodesic
from tramline.operators import lines, mvt, poi, polygons, publish, rail
from tramline.operators.store import first_wins
from tramline.plans import api
from tramline.plans.catalog import LINE_ORDER, PLACES, ST, places, query, stop_times, table
from tramline.plans.stages import folder, stored
from tramline.sources import osm, pbf, registry

NO_REFS, NO_MEMBERS = "array<long>", "array<struct<kind:string,ref:long,role:string>>"


def _place(key: str) -> tuple[Column, Column]:
    """A place for a key, whole units of the format."""
    return (F.col(key) * 37 % 1800 - 900) / F.lit(10.0), (F.col(key) * 53 % 800 - 400) / F.lit(10.0)


LON, LAT = "(({k} * 37 % 1800 - 900) / 10.0::DOUBLE)", "(({k} * 53 % 800 - 400) / 10.0::DOUBLE)"


def _row(df: DataFrame, kind: str, key: str, tags: Column, **more: Column) -> DataFrame:
    given = {"kind": F.lit(kind), "id": F.col(key).cast("long"), "tags": tags} | more
    kinds = {"lon": "double", "lat": "double", "refs": NO_REFS, "members": NO_MEMBERS}
    return df.select(*(given.get(n, F.lit(None)).cast(kinds[n]).alias(n) if n in kinds else given[n].alias(n) for n in ("kind", "id", "tags", "lon", "lat", "refs", "members")))


def _extract(spark, objects: DataFrame, *kinds: str) -> DataFrame:
    """The objects written as PBF files and read back."""
    path = f"{folder(spark)}/extract-{uuid.uuid4().hex}"
    pbf.write_pbf(objects, path)
    return pbf.read_pbf(spark, path, *kinds)


def _orders_and_suppliers(spark, d: str) -> DataFrame:
    """Orders as ways over suppliers in the order of their lines, and the suppliers that are not in debt as nodes."""
    lon, lat = _place("s_suppkey")
    nodes = _row(table(spark, d, "supplier").where("s_acctbal >= 0"), "node", "s_suppkey", F.create_map(F.lit("name"), F.col("s_name")), lon=lon, lat=lat)
    refs = stop_times(spark, d).groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("stop_sequence", "stop"))), lambda x: x["stop"].cast("long")).alias("refs"))
    ways = refs.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("trip_id"), "o_orderstatus"), "trip_id")
    tags = F.create_map(F.lit("railway"), F.when(F.col("o_orderstatus") == "F", "rail").otherwise("disused"))
    return nodes.unionByName(_row(ways, "way", "trip_id", tags, refs=F.col("refs")))


@query(f"""SELECT 'node' AS kind, c_custkey AS id, c_name AS name, {LON.format(k='c_custkey')} AS lon, {LAT.format(k='c_custkey')} AS lat, 0 AS refs FROM customer
UNION ALL SELECT 'way', c_nationkey, 'N' || c_nationkey, NULL, NULL, CAST(count(*) AS INTEGER) FROM customer GROUP BY c_nationkey
UNION ALL SELECT 'relation', n_regionkey, n_name, NULL, NULL, 1 FROM nation""")
def map_scan(spark, d):
    """Nodes of customers, ways of nations and a relation of each nation, written as PBF and read back."""
    c = table(spark, d, "customer")
    lon, lat = _place("c_custkey")
    name = lambda x: F.create_map(F.lit("name"), x)
    nodes = _row(c, "node", "c_custkey", name(F.col("c_name")), lon=lon, lat=lat)
    ways = _row(c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.col("c_custkey").cast("long"))).alias("refs")), "way", "c_nationkey", name(F.concat(F.lit("N"), "c_nationkey")), refs=F.col("refs"))
    member = F.array(F.struct(F.lit("way").alias("kind"), F.col("n_nationkey").cast("long").alias("ref"), F.lit("").alias("role")))
    relations = _row(table(spark, d, "nation"), "relation", "n_regionkey", name(F.col("n_name")), members=member)
    back = _extract(spark, nodes.unionByName(ways).unionByName(relations))
    return back.select("kind", "id", osm.tag_of("name").alias("name"), F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), (F.coalesce(F.size("refs"), F.lit(0)) + F.coalesce(F.size("members"), F.lit(0))).alias("refs"))


@query(f"""WITH {ST}, p AS (SELECT l_orderkey, l_linenumber, s_suppkey FROM st LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal >= 0),
w AS (SELECT l_orderkey AS id, count(s_suppkey) AS points, count(*) - count(s_suppkey) AS missing, arg_min(s_suppkey, l_linenumber) FILTER (WHERE s_suppkey IS NOT NULL) AS first, arg_max(s_suppkey, l_linenumber) FILTER (WHERE s_suppkey IS NOT NULL) AS last FROM p GROUP BY l_orderkey)
SELECT id, points, missing, {LON.format(k='first')} AS first_lon, {LAT.format(k='last')} AS last_lat FROM w JOIN orders ON o_orderkey = id""")
def way_assembly(spark, d):
    """Ways of an extract with the places of their nodes in order, and how many the extract lacks."""
    out = osm.way_lines(_extract(spark, _orders_and_suppliers(spark, d)))
    return out.select("id", F.size("line").cast("long").alias("points"), F.col("missing").cast("long").alias("missing"), F.round(F.get("line", F.lit(0))["lon"], 7).alias("first_lon"), F.round(F.get("line", F.size("line") - 1)["lat"], 7).alias("last_lat"))


@query(f"""WITH {ST}, w AS (SELECT * FROM st JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F')
SELECT DISTINCT 'way' AS kind, l_orderkey AS id FROM w UNION ALL SELECT DISTINCT 'node', l_suppkey FROM w JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal >= 0""")
def extract_filter(spark, d):
    """The railways of an extract and the nodes that they need, as a filter by tags writes them, read again."""
    objects = _extract(spark, _orders_and_suppliers(spark, d))
    return _extract(spark, osm.matching(objects, F.coalesce(osm.tag_of("railway") == "rail", F.lit(False)))).select("kind", "id")


@query(f"""WITH {ST}, i AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM st),
m AS (SELECT l_orderkey, island, count(*) + 1 AS points, arg_min(l_linenumber, l_partkey * 100 + l_linenumber) AS part, min(l_linenumber) AS low, max(l_linenumber) + 1 AS high FROM i GROUP BY l_orderkey, island)
SELECT m.l_orderkey AS id, points, CAST(CASE WHEN l_returnflag = 'R' THEN high ELSE low END AS DOUBLE) AS begins FROM m JOIN st ON st.l_orderkey = m.l_orderkey AND st.l_linenumber = m.part""")
def merged_ways(spark, d):
    """Parts of ways, each from one line number to the next or back, in any order, merged to lines."""
    k = F.col("l_linenumber")
    at = lambda x: F.struct(x.cast("double").alias("lon"), (x % 3).cast("double").alias("lat"))
    line = F.when(F.col("l_returnflag") == "R", F.array(at(k + 1), at(k))).otherwise(F.array(at(k), at(k + 1)))
    # by order at once, so that lines move once both for their first row and for their way
    st = first_wins(table(spark, d, "lineitem").repartition("l_orderkey"), ["l_orderkey", "l_linenumber"], LINE_ORDER)
    parts = st.select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") * 100 + k).alias("part"), line.alias("line"))
    return lines.merge_lines(parts, ["id"], stored).select("id", F.size("line").cast("long").alias("points"), F.get("line", F.lit(0))["lon"].alias("begins"))


# --- areas: each customer a square of a grid, its nation the area it belongs to ----


CELLS = "c AS (SELECT c_custkey, c_nationkey AS n, c_custkey % 50 AS x, c_custkey // 50 AS y FROM customer)"


def _squares(spark, d: str) -> DataFrame:
    k = F.col("c_custkey")
    x, y = k % 50, F.floor(k / 50)
    corner = lambda i, j: F.struct(((x + i) / F.lit(8.0)).alias("lon"), ((y + j) / F.lit(8.0)).alias("lat"))
    ring = [corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0)]
    turned = F.when(F.col("c_acctbal") < 0, F.array(*ring[::-1])).otherwise(F.array(*ring))
    # a small file that makes many rings is one task's unless its rows are dealt out
    dealt = table(spark, d, "customer").repartition("c_custkey")
    return dealt.select(F.concat(F.lit("N"), "c_nationkey").alias("state_code"), F.col("c_custkey").alias("polygon"), F.lit(0).alias("nth"), turned.alias("ring"))


@query(f"""WITH {CELLS} SELECT 'N' || n AS state_code, count(*)::DOUBLE AS cells,
  CAST(sum((SELECT 4 - count(*) FROM c o WHERE o.n = c.n AND abs(o.x - c.x) + abs(o.y - c.y) = 1)) AS BIGINT) AS corners FROM c GROUP BY n""")
def dissolved_areas(spark, d):
    """Squares of customers united by nation: the area of the union, and the borders left."""
    united = polygons.union_polygons(_squares(spark, d), ["state_code"], stored)
    return united.groupBy("state_code").agg(F.sum(polygons.signed_area(F.col("ring")) * 32).alias("cells"), F.sum(F.size("ring") - 1).alias("corners"))


@query("SELECT c_custkey, 'N' || c_nationkey AS state_code FROM customer")
def enclave_states(spark, d):
    """The nation of the middle of each square by the united areas: in a hole it is the enclave's."""
    united = polygons.union_polygons(_squares(spark, d), ["state_code"], stored)
    middle = lambda axis: (F.get("ring", F.lit(0))[axis] + F.get("ring", F.lit(2))[axis]) / 2
    points = _squares(spark, d).select(F.col("polygon").alias("c_custkey"), middle("lon").alias("lon"), middle("lat").alias("lat"))
    return poi.states_of_points(points, united.select("state_code", "ring"), 1.0).select("c_custkey", "state_code")


@query("""WITH k AS (SELECT n_nationkey, n_name, n_regionkey, '0' || (n_regionkey + 1) AS key FROM nation),
s AS (SELECT *, CASE key WHEN '01' THEN 'DE-SH' WHEN '02' THEN 'DE-HH' WHEN '03' THEN 'DE-NI' WHEN '04' THEN 'DE-HB' END AS state_code, n_nationkey - row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS island FROM k)
SELECT state_code, max(n_name) AS name, min(key) AS official_key, CAST(count(DISTINCT island) AS INTEGER) AS rings FROM s WHERE state_code IS NOT NULL GROUP BY state_code""")
def boundary_states(spark, d):
    """Boundaries of nations, squares side by side in a GeoJSON file, united by state: the largest name, the smallest key, all rings."""
    k = F.col("n_nationkey")
    ring = F.array(*(F.array(F.lit(1.0) * (k + i), F.lit(50.0) + j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))
    feature = F.struct(F.struct(F.col("n_name").alias("GEN"), F.concat(F.lit("0"), F.col("n_regionkey") + 1).alias("AGS")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    path = f"{folder(spark)}/boundaries-{uuid.uuid4().hex}"
    whole = table(spark, d, "nation").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    whole.write.text(f"{path}/whole")
    return registry.dissolve(registry.boundaries(spark, f"{path}/whole")).select("state_code", "name", "official_key", F.size("rings").alias("rings"))


# --- rails: suppliers as the nodes of a grid of tracks ------------------------------


GRID_WIDTH = 40


def supplier_tracks(spark, d: str) -> DataFrame:
    """Ways (id, tags, parts) from each supplier to the next one and to the one a row up, each of two parts that both begin in its middle; the rich ones' tracks are yards."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    x, y = F.col("k") % GRID_WIDTH, F.floor(F.col("k") / GRID_WIDTH)
    at = lambda i, j: F.struct((8 + (x + i) / 20).alias("lon"), (53 + (y + j) / 20).alias("lat"))
    there = s.select((F.col("k") - 1).alias("k")), s.select((F.col("k") - GRID_WIDTH).alias("k"))
    tags = F.create_map(F.lit("railway"), F.lit("rail"), F.lit("service"), F.when(F.col("s_acctbal") > 8000, "yard").otherwise(""))
    part = lambda i, j: F.array(at(i / 2 + j / 8, j / 2 + i / 8), at(i, j))
    way = lambda name, i, j: s.select(F.concat(F.lit(name), "k").alias("id"), tags.alias("tags"), F.array(part(i, j), F.array(F.get(part(i, j), F.lit(0)), at(0, 0))).alias("parts"), "k")
    east, north = way("e", 1, 0).where(x < GRID_WIDTH - 1).join(there[0], "k", "left_semi"), way("n", 0, 1).join(there[1], "k", "left_semi")
    return east.unionByName(north).drop("k")


def supplier_stops(spark, d: str) -> DataFrame:
    """Suppliers as stops beside their node; those in debt too far off to snap."""
    k = F.col("s_suppkey")
    off = F.when(F.col("s_acctbal") < 0, 0.02).otherwise(0.002)
    return table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("public_id"), (8 + k % GRID_WIDTH / 20 + off).alias("lon"), (53 + F.floor(k / GRID_WIDTH) / 20 + off).alias("lat"))


#: The middle of a track and its length, from (x, y) by (i, j).
TRACKS = """s AS (SELECT s_suppkey AS k, s_acctbal > 8000 AS yard, s_suppkey % 40 AS x, s_suppkey // 40 AS y FROM supplier),
w AS (SELECT 'e' || s.k AS id, s.yard, s.x, s.y, 1 AS i, 0 AS j FROM s JOIN supplier o ON o.s_suppkey = s.k + 1 WHERE s.x < 39 UNION ALL SELECT 'n' || s.k, s.yard, s.x, s.y, 0, 1 FROM s JOIN supplier o ON o.s_suppkey = s.k + 40),
p AS (SELECT *, 8 + x / 20.0::DOUBLE AS x1, 53 + y / 20.0::DOUBLE AS y1, 8 + (x + i / 2.0::DOUBLE + j / 8.0::DOUBLE) / 20 AS x2, 53 + (y + j / 2.0::DOUBLE + i / 8.0::DOUBLE) / 20 AS y2, 8 + (x + i) / 20.0::DOUBLE AS x3, 53 + (y + j) / 20.0::DOUBLE AS y3 FROM w),
l AS (SELECT *, 2 * 6371008.8 * (asin(sqrt(power(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * power(sin(radians(x2 - x1) / 2), 2)))
  + asin(sqrt(power(sin(radians(y3 - y2) / 2), 2) + cos(radians(y2)) * cos(radians(y3)) * power(sin(radians(x3 - x2) / 2), 2)))) AS m FROM p)"""


@query(f"WITH {TRACKS} SELECT id AS edge_id, round(m, 3) AS length_m, round(CASE WHEN yard THEN 8 ELSE 1 END * m, 3) AS cost, yard AS is_service FROM l")
def rail_graph(spark, d):
    """Edges of the suppliers' tracks, their parts merged, with length, and cost eight times as high on service tracks."""
    edges = rail.rail_edges(rail.rail_ways(rail.merged_ways(supplier_tracks(spark, d), stored)))
    return edges.select("edge_id", F.round("length_m", 3).alias("length_m"), F.round("cost", 3).alias("cost"), "is_service")


@query(f"""WITH {PLACES}, edges AS (SELECT 'e-' || id AS id, lon AS x1, lat AS y1, lon + 0.4 AS x2, lat AS y2 FROM places UNION ALL SELECT 'n-' || id, lon, lat, lon, lat + 0.25 FROM places)
SELECT id AS edge_id FROM edges WHERE greatest(x1, x2) >= 9.55 AND least(x1, x2) <= 10.45 AND greatest(y1, y2) >= 53.5 AND least(y1, y2) <= 54.45""")
def corridor_filter(spark, d):
    """Tracks from each place to the east and to the north that meet a named corridor, whether or not they end in it."""
    track = lambda name, i, j: F.struct(F.concat(F.lit(name), "id").alias("id"), F.array(F.struct("lon", "lat"), F.struct((F.col("lon") + i).alias("lon"), (F.col("lat") + j).alias("lat"))).alias("line"))
    tracks = places(spark, d).select(F.explode(F.array(track("e-", 0.4, 0.0), track("n-", 0.0, 0.25))).alias("t")).select("t.*", F.create_map(F.lit("railway"), F.lit("rail")).alias("tags"))
    return rail.rail_edges(rail.rail_ways(tracks)).where(rail.meets_box(F.col("line"), rail.box_of(corridor="hamburg-kiel"))).select("edge_id")


#: The iteration for the longitude on the auxiliary sphere written out, eight rounds of it.
SPHEROID = f"""{PLACES}, c AS (SELECT id, 1 / 298.257223563::DOUBLE AS f, radians(3.0::DOUBLE + lat / 60) AS l, atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(lat))) AS u1, atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(lat - 20))) AS u2 FROM places),
r AS (SELECT 0 AS n, id, f, l, u1, u2, l AS t FROM c UNION ALL SELECT n + 1, id, f, l, u1, u2, l + (1 - cc) * f * sa * (acos(cs) + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) FROM
  (SELECT *, f / 16 * ca * (4 + f * (4 - 3 * ca)) AS cc, cs - 2 * sin(u1) * sin(u2) / ca AS cm FROM (SELECT *, 1 - sa * sa AS ca FROM (SELECT *, cos(u1) * cos(u2) * sin(t) / ss AS sa FROM
  (SELECT *, sqrt(power(cos(u2) * sin(t), 2) + power(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(t), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(t) AS cs FROM r WHERE n < 12)))))"""


@query(f"""WITH RECURSIVE {SPHEROID}, e AS (SELECT *, cs - 2 * sin(u1) * sin(u2) / ca AS cm, ca * (power(6378137.0, 2) - power(6378137.0 * (1 - f), 2)) / power(6378137.0 * (1 - f), 2) AS k FROM (SELECT *, 1 - power(cos(u1) * cos(u2) * sin(t) / ss, 2) AS ca FROM
  (SELECT *, sqrt(power(cos(u2) * sin(t), 2) + power(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(t), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(t) AS cs FROM r WHERE n = 12))),
g AS (SELECT *, 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))) AS a, k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) AS b FROM e)
SELECT id, round(6378137.0 * (1 - f) * a * (atan2(ss, cs) - b * ss * (cm + b / 4 * (cs * (2 * cm * cm - 1) - b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))), 3) AS meters FROM g""")
def spheroid_distances(spark, d):
    """Length on the spheroid of a line from each place to one far to the south and a few degrees aside."""
    line = F.array(F.struct("lon", "lat"), F.struct((F.col("lon") + 3 + F.col("lat") / 60).alias("lon"), (F.col("lat") - 20).alias("lat")))
    return places(spark, d).select("id", F.round(geodesic.spheroid_length(line), 3).alias("meters"))


@query("""SELECT s_suppkey AS id, upper(s_name) AS name, 'second' AS snapshot_id, (SELECT count(*) FROM nation) AS others FROM supplier""")
def published_snapshot(spark, d):
    """The live snapshot of two published one after the other: its tables whole, and none of the other's rows."""
    shop = publish.Publication(spark, f"{folder(spark)}/published-{uuid.uuid4().hex}")
    own = lambda name: table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), name.alias("name"))
    nations = table(spark, d, "nation").select("n_nationkey")
    shop.publish({"stops": own(F.col("s_name")), "areas": nations}, "first")
    shop.activate("first")
    shop.publish({"stops": own(F.upper("s_name")), "areas": nations}, "second")
    now = shop.activate("second")
    n = shop.live("areas", now).agg(F.count(F.lit(1)).alias("others"))
    return shop.live("stops", now).crossJoin(F.broadcast(n))  # one row


@query()
def rail_matching(spark, d):
    """Patterns matched to rails, from the parts of ways to the rating: a pattern a month, its stops the first supplier of each day that lines were shipped."""
    ways = rail.rail_ways(rail.merged_ways(supplier_tracks(spark, d), stored))
    edges = stored(rail.rail_edges(ways))
    stops = supplier_stops(spark, d)
    snaps = stored(rail.snap_stops(stops, edges))
    day = table(spark, d, "lineitem").groupBy("l_shipdate").agg(F.min("l_suppkey").alias("k"))
    calls = stored(day.select(F.date_format("l_shipdate", "yyyy-MM").alias("pattern_id"), F.dayofmonth("l_shipdate").alias("stop_sequence"), F.concat(F.lit("s"), "k").alias("stop_place_id")))
    points = calls.join(stops, calls["stop_place_id"] == stops["public_id"]).groupBy("pattern_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("stop_sequence", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line"))
    out = rail.match_patterns(points, calls, stops, snaps, edges, stored)
    return out.select("pattern_id", "status", "total_segments", "failed_segments", F.round("confidence", 6).alias("confidence"), F.round("detour", 6).alias("detour"), F.size("lines").alias("edges"))


# --- tiles, read back feature by feature ---------------------------------------------


def _scaled(z: int, x: int, y: int, lon: str = "lon", lat: str = "lat") -> tuple[str, str]:
    """SQL of a place in units of a tile."""
    west, _, east, north = geo.tile_bounds(z, x, y)
    scale = geo.EXTENT / (east - west)
    return f"((radians({lon}) * {geo.MERCATOR_M!r}::DOUBLE - ({west!r}::DOUBLE)) * {scale!r}::DOUBLE)", f"(({north!r}::DOUBLE - ln(tan(pi() / 4 + radians({lat}) / 2)) * {geo.MERCATOR_M!r}::DOUBLE) * {scale!r}::DOUBLE)"


PLACE_TILE, RAIL_TILE = (7, 67, 41), (8, 133, 83)
PX, PY = _scaled(*PLACE_TILE)


@query(f"""WITH {PLACES} SELECT c_name AS name, c_mktsegment AS category, CAST(floor({PX}) AS INTEGER) AS x, CAST(floor({PY}) AS INTEGER) AS y FROM places WHERE {PX} BETWEEN -96 AND 2144 AND {PY} BETWEEN -96 AND 2144 AND c_acctbal >= 0""")
def place_tiles(spark, d):
    """Places of a tile that are not deleted, where they are drawn."""
    rows = places(spark, d).select("lon", "lat", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"), F.lit("SH").alias("state_code"), F.when(F.col("c_acctbal") < 0, F.lit("2026-01-01")).alias("deleted_at"))
    found = mvt.features_of(api.place_tile(rows, *PLACE_TILE))
    at = F.get(F.get("parts", F.lit(0)), F.lit(0))
    return found.select(F.col("properties")["name"].alias("name"), F.col("properties")["category"].alias("category"), at["x"].alias("x"), at["y"].alias("y"))


def _crosses(a: tuple[str, str], b: tuple[str, str]) -> str:
    """SQL of whether a step meets a tile with its margin."""
    to = lambda i, bound: f"(({bound} - {a[i]}) / nullif({b[i]} - {a[i]}, 0))"
    enter = ", ".join(f"least({to(i, -96)}, {to(i, 2144)})" for i in (0, 1))
    leave = ", ".join(f"greatest({to(i, -96)}, {to(i, 2144)})" for i in (0, 1))
    return f"(greatest(0, {enter}) <= least(1, {leave}))"


A, B, C = (_scaled(*RAIL_TILE, f"x{i}", f"y{i}") for i in (1, 2, 3))


@query(f"WITH {TRACKS} SELECT id AS edge_id, CAST(yard AS VARCHAR) AS is_service FROM l WHERE {_crosses(A, B)} OR {_crosses(B, C)}")
def rail_tiles(spark, d):
    """Tracks of the suppliers' grid that a tile draws."""
    edges = rail.rail_edges(rail.rail_ways(rail.merged_ways(supplier_tracks(spark, d), stored)))
    found = mvt.features_of(api.rail_tile(edges, *RAIL_TILE))
    return found.select(F.col("properties")["edge_id"].alias("edge_id"), F.col("properties")["is_service"].alias("is_service"))


@query(f"""WITH {CELLS}, b AS (SELECT n, greatest(x * 1024, -96) AS x1, least((x + 1) * 1024, 2144) AS x2, greatest(y * 1024, -96) AS y1, least((y + 1) * 1024, 2144) AS y2 FROM (SELECT n, x - 2 AS x, 3 - y AS y FROM c))
SELECT 'N' || n AS state_code, CAST(sum((x2 - x1) * (y2 - y1)) AS BIGINT) AS units FROM b WHERE x2 > x1 AND y2 > y1 GROUP BY n""")
def area_tiles(spark, d):
    """The united squares of nations drawn as polygons with holes in one tile: the area that each covers there, in units of the tile."""
    z, x0, y0 = 9, 300, 200
    half = lambda i: geo.inverse_mercator(geo.tile_bounds(z, x0, y0)[0] + i * geo.HALF_MAP / 2**z, 0)[0]
    at = lambda j: geo.inverse_mercator(0, geo.tile_bounds(z, x0, y0)[3] - j * geo.HALF_MAP / 2**z)[1]
    # squares of half a tile: the grid's are stretched so that corners fall on whole units
    united = polygons.union_polygons(_squares(spark, d), ["state_code"], stored)
    lon = lambda p: F.lit(half(0)) + (F.round(p["lon"] * 8) - 2) * (half(1) - half(0)) + 1e-9
    y = lambda p: geo.tile_bounds(z, x0, y0)[3] - (4 - F.round(p["lat"] * 8)) * (geo.HALF_MAP / 2**z)
    lat = lambda p: F.degrees(2 * F.atan(F.exp(y(p) / geo.MERCATOR_M)) - math.pi / 2) - 1e-9
    drawn = F.transform("ring", lambda p: F.struct(lon(p).alias("lon"), lat(p).alias("lat")))
    # only rings whose box meets the tile are gathered; a hole that does lies in an outer ring that does, and any of those serves for its area
    met = united.select("state_code", (~F.col("outer")).cast("int").alias("nth"), drawn.alias("ring")).where(geo.box_meets(F.col("ring"), geo.tile_degrees(z, x0, y0)))
    rings = met.groupBy("state_code").agg(F.array_sort(F.collect_list(F.struct("nth", "ring"))).alias("points"))
    tiles = mvt.tiles(rings.select(F.lit(z).alias("z"), F.lit(x0).alias("x"), F.lit(y0).alias("y"), "points", "state_code"), "areas", ["state_code"], polygons=True)
    ring = lambda p: F.zip_with(p, F.concat(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, 1)), lambda a, b: a["x"].cast("long") * b["y"] - b["x"].cast("long") * a["y"])
    area = F.aggregate(F.flatten(F.transform("parts", ring)), F.lit(0).cast("long"), lambda s, v: s + v) / 2
    return mvt.features_of(tiles).select(F.col("properties")["state_code"].alias("state_code"), area.cast("long").alias("units"))

"""A staged feed to places, stops, routes, trips, stop times, patterns and stop-pair segments.

Ids are the feed's own keys or hashes of them, so a run gives the same tables
each time.  Every step is a plan over the feed's tables; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import bound, haversine_m, line_length
from tramline.functions.modes import mode_of
from tramline.functions.text import blank_to_null, number, squeezed
from tramline.functions.times import gtfs_seconds
from tramline.operators.store import first_wins


def stop_places(stops: DataFrame) -> DataFrame:
    """Parent stations, and stops without a known parent as places of their own.

    A place without coordinates takes the mean of its children's; places left
    without any are dropped.
    """
    own = stops.select("stop_id", F.col("stop_name").alias("name"), number(F.col("stop_lat")).alias("lat"), number(F.col("stop_lon")).alias("lon"), F.coalesce(F.col("location_type").try_cast("int"), F.lit(0)).alias("kind"), blank_to_null(F.col("parent_station")).alias("parent"))
    own = first_wins(own, ["stop_id"], ["name"])
    parents = own.where("kind = 1")
    orphans = own.where("kind != 1").join(parents.select(F.col("stop_id").alias("parent")), "parent", "left_anti").where("kind = 0 or parent is not null")
    children = own.where("parent is not null").groupBy(F.col("parent").alias("stop_id")).agg(F.avg("lat").alias("child_lat"), F.avg("lon").alias("child_lon"))
    places = parents.unionByName(orphans).join(children, "stop_id", "left")
    dhid = F.when(F.col("stop_id").rlike("^de:[0-9]+"), F.col("stop_id"))
    return places.select(
        F.col("stop_id").alias("public_id"),
        "name",
        squeezed(F.col("name")).alias("normalized_name"),
        F.coalesce("lat", "child_lat").alias("lat"),
        F.coalesce("lon", "child_lon").alias("lon"),
        dhid.alias("dhid"),
        F.when(dhid.isNull(), "missing_dhid").otherwise("dhid").alias("identity_quality"),
        F.lit(True).alias("is_display_stop"),
    ).where("lat is not null and lon is not null")


def technical_stops(stops: DataFrame, places: DataFrame) -> DataFrame:
    """Stops with their place; a stop whose named parent is no place has none and is left out."""
    place = F.coalesce(blank_to_null(F.col("parent_station")), F.col("stop_id"))
    rows = stops.select("stop_id", F.col("stop_name").alias("name"), place.alias("public_id"), F.coalesce(F.col("location_type").try_cast("int"), F.lit(0)).alias("location_type"), blank_to_null(F.col("platform_code")).alias("platform_code"))
    return first_wins(rows, ["stop_id"], ["name"]).join(places.select("public_id"), "public_id").withColumnRenamed("public_id", "stop_place_id")


def routes(staged: DataFrame) -> DataFrame:
    kind = F.col("route_type").try_cast("int")
    rows = staged.select("route_id", "agency_id", blank_to_null(F.col("route_short_name")).alias("short_name"), blank_to_null(F.col("route_long_name")).alias("long_name"), kind.alias("route_type"), mode_of(kind, F.col("route_short_name")).alias("mode"), blank_to_null(F.col("route_color")).alias("color"))
    return first_wins(rows, ["route_id"], ["agency_id", "short_name"])


def agencies(staged: DataFrame) -> DataFrame:
    rows = staged.select("agency_id", blank_to_null(F.col("agency_name")).alias("agency_name"), blank_to_null(F.col("agency_url")).alias("agency_url"), blank_to_null(F.col("agency_timezone")).alias("timezone"))
    return first_wins(rows, ["agency_id"], ["agency_name"])


def with_agency(lines: DataFrame, agency: DataFrame) -> DataFrame:
    """Routes with their operator's name; a route of an unknown agency has none."""
    return lines.join(agency.select("agency_id", "agency_name"), "agency_id", "left")


def stop_times(staged: DataFrame, stops: DataFrame) -> DataFrame:
    """Typed stop times with their place; blank times are null, rows of unknown stops are left out."""
    whole = lambda c: F.col(c).try_cast("int")
    rows = staged.select("trip_id", whole("stop_sequence").alias("stop_sequence"), "stop_id", gtfs_seconds(F.col("arrival_time")).alias("arrival_s"), gtfs_seconds(F.col("departure_time")).alias("departure_s"), whole("pickup_type").alias("pickup_type"), whole("drop_off_type").alias("drop_off_type"))
    # places come first, then each row moves to its trip once, for its number and for all that is asked of trips
    rows = rows.join(stops.select("stop_id", "stop_place_id"), "stop_id", "left").repartition("trip_id")
    return first_wins(rows, ["trip_id", "stop_sequence"], ["stop_id", "arrival_s"]).where("stop_place_id is not null")


def signature(times: DataFrame, trip: str = "trip_id", order: str = "stop_sequence", parts: tuple[str, ...] = ("stop_id", "pickup_type", "drop_off_type")) -> DataFrame:
    """trip, signature: its stops in order, each with its flags, as one text."""
    item = F.concat_ws(":", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))
    return times.groupBy(trip).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))), lambda x: x["i"]), ">").alias("signature"))


CALL = ["stop_sequence", "stop_id", "stop_place_id", "pickup_type", "drop_off_type"]


def route_patterns(trips: DataFrame, times: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns, trip_id with pattern_id): trips of a route, direction and shape with one signature share a pattern.

    A pattern's representative is its trip with the smallest id, whose calls
    (CALL, in order) it carries.
    """
    listed = times.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct(*CALL))).alias("calls"))
    item = lambda c: F.concat_ws(":", *(F.coalesce(c[p].cast("string"), F.lit("")) for p in ("stop_id", "pickup_type", "drop_off_type")))
    listed = listed.withColumn("stop_hash", F.md5(F.array_join(F.transform("calls", item), ">").cast("binary")))
    own = trips.select("trip_id", "route_id", F.coalesce("direction_id", F.lit("")).alias("direction_id"), F.coalesce("shape_id", F.lit("")).alias("shape_id"))
    signed = own.join(listed, "trip_id").withColumn("pattern_id", F.sha2(F.concat_ws("|", "route_id", "direction_id", "shape_id", "stop_hash"), 256))
    first = F.min(F.struct(F.col("trip_id").alias("representative"), "route_id", "direction_id", "shape_id", "stop_hash", "calls")).alias("r")
    patterns = signed.groupBy("pattern_id").agg(first, F.count(F.lit(1)).alias("trips"))
    return patterns.select("pattern_id", "r.*", "trips"), signed.select("trip_id", "pattern_id")


def pattern_stops(patterns: DataFrame) -> DataFrame:
    return patterns.select("pattern_id", "route_id", F.explode("calls").alias("c")).select("pattern_id", "route_id", "c.*")


def shape_lines(shapes: DataFrame) -> DataFrame:
    """shape_id, points (lon, lat in order), and the distance from the feed: last less first, null if it falls or is missing."""
    point = F.struct(F.col("shape_pt_sequence").try_cast("int").alias("o"), number(F.col("shape_pt_lon")).alias("lon"), number(F.col("shape_pt_lat")).alias("lat"), number(F.col("shape_dist_traveled")).alias("d"))
    out = shapes.groupBy("shape_id").agg(F.array_sort(F.collect_list(point)).alias("p")).where(F.size("p") >= 2)
    along = F.element_at("p", -1)["d"] - F.element_at("p", 1)["d"]
    return out.select("shape_id", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("points"), F.when(along >= 0, along).alias("distance"))


def pattern_lines(patterns: DataFrame, places: DataFrame, shapes: DataFrame) -> DataFrame:
    """Patterns with their line: the shape's, else one through the places, with its quality and length."""
    # a pattern is named by its representative here, which is shorter
    calls = patterns.select("representative", F.explode("calls").alias("c")).select("representative", "c.stop_sequence", "c.stop_place_id")
    at = calls.join(places.select(F.col("public_id").alias("stop_place_id"), "lon", "lat"), "stop_place_id")
    rough = at.groupBy("representative").agg(F.array_sort(F.collect_list(F.struct("stop_sequence", "lon", "lat"))).alias("p"))
    rough = rough.select("representative", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("rough")).where(F.size("rough") >= 2)
    kept = [c for c in patterns.columns if c != "calls"]
    out = patterns.select(*kept).join(shape_lines(shapes), "shape_id", "left").join(rough, "representative", "left")
    line = F.coalesce("points", "rough")
    quality = F.when(F.col("points").isNotNull(), "official_gtfs").when(F.col("rough").isNotNull(), "stop_sequence_approximation")
    return out.select(*kept, line.alias("line"), quality.alias("geometry_quality"), line_length(line).alias("length_m"), F.col("distance").alias("shape_distance"))


def stop_pairs(rows: DataFrame, group: list[str], order: str, place: str) -> DataFrame:
    """group, low, high: unordered pairs of neighbouring places, each once; rows without a place count as not there."""
    following = F.lead(place).over(Window.partitionBy(*group).orderBy(order))
    pairs = rows.where(F.col(place).isNotNull()).withColumn("next", following).where(F.col("next").isNotNull() & (F.col("next") != F.col(place)))
    return pairs.select(*group, F.least(place, "next").alias("low"), F.greatest(place, "next").alias("high"))


def route_segments(patterns: DataFrame, places: DataFrame) -> DataFrame:
    """Stop pairs of each route with their straight length."""
    place = F.filter(F.transform("calls", lambda c: c["stop_place_id"]), lambda p: p.isNotNull())
    rest = lambda p, at: F.slice(p, at, F.greatest(F.size(p) - 1, F.lit(0)))
    pair = lambda a, b: F.when(a != b, F.struct(F.least(a, b).alias("from_id"), F.greatest(a, b).alias("to_id")))
    pairs = bound(place, lambda p: F.filter(F.zip_with(rest(p, 1), rest(p, 2), pair), lambda x: x.isNotNull()))
    pairs = patterns.select("route_id", F.explode(pairs).alias("x")).select("route_id", "x.*").distinct()
    end = lambda side: places.select(F.col("public_id").alias(f"{side}_id"), F.col("lon").alias(f"{side}_lon"), F.col("lat").alias(f"{side}_lat"))
    out = pairs.join(end("from"), "from_id").join(end("to"), "to_id")
    return out.withColumn("length_m", haversine_m(F.col("from_lon"), F.col("from_lat"), F.col("to_lon"), F.col("to_lat")))


def modes_of_places(places: DataFrame, patterns: DataFrame, route_table: DataFrame) -> DataFrame:
    """Places with the sorted modes of the routes that serve them, an empty list if none do."""
    served = patterns.select("route_id", F.array_distinct(F.transform("calls", lambda c: c["stop_place_id"])).alias("at")).join(route_table.select("route_id", "mode"), "route_id")
    modes = served.select("mode", F.explode("at").alias("public_id")).groupBy("public_id").agg(F.array_sort(F.collect_set("mode")).alias("modes"))
    return places.join(modes, "public_id", "left").withColumn("modes", F.coalesce("modes", F.array().cast("array<string>")))


def normalise(feed: dict[str, DataFrame], states: DataFrame | None = None) -> dict[str, DataFrame]:
    """All normalised tables of a staged feed; states (state_code, rings) give places their state, which is null without them."""
    from tramline.operators.calendar import service_dates
    from tramline.operators.poi import states_of_points

    places = stop_places(feed["stops"])
    places = places.withColumn("state_code", F.lit(None).cast("string")) if states is None else states_of_points(places, states)
    agency = agencies(feed["agency"])
    stops, lines = technical_stops(feed["stops"], places), with_agency(routes(feed["routes"]), agency)
    times = stop_times(feed["stop_times"], stops)
    trips = feed["trips"].join(lines.select("route_id"), "route_id")
    patterns, of_trip = route_patterns(trips, times)
    return {
        "stop_places": modes_of_places(places, patterns, lines),
        "agencies": agency,
        "stops": stops,
        "routes": lines,
        "trips": trips.join(of_trip, "trip_id", "left"),
        "stop_times": times,
        "service_dates": service_dates(feed["calendar"], feed["calendar_dates"]),
        "route_patterns": pattern_lines(patterns, places, feed["shapes"]),
        "route_pattern_stops": pattern_stops(patterns),
        "route_stop_segments": route_segments(patterns, places),
        "transfers": feed["transfers"].select("from_stop_id", "to_stop_id", F.coalesce(F.col("min_transfer_time").try_cast("int"), F.lit(0)).alias("seconds")),
    }


def prefixed_dates(dates: DataFrame, snapshot: str) -> DataFrame:
    """Service dates as the rows of their load file: snapshot, service, date, flag and source."""
    return dates.select(F.lit(snapshot).alias("snapshot_id"), "service_id", F.date_format("service_date", "yyyy-MM-dd").alias("service_date"), F.col("is_active").cast("string").alias("is_active"), "source")


def write_dates(dates: DataFrame, snapshot: str, path: str) -> None:
    prefixed_dates(dates, snapshot).write.mode("overwrite").csv(path, header=True)


def boards(flag: Column) -> Column:
    """Whether a pickup or drop-off flag allows it; null does."""
    return F.coalesce(flag, F.lit(0)) != 1


def direct_connections(times: DataFrame, origin: Column, trips: DataFrame | None = None) -> DataFrame:
    """destination, trips: how many trips lead from a stop that origin names to each later stop.

    times: trip_id, stop_sequence, stop, pickup_type, drop_off_type; trips limits them, as to one service day.
    """
    if trips is not None:
        times = times.join(trips.select("trip_id").distinct(), "trip_id", "left_semi")
    trip = Window.partitionBy("trip_id")
    boarded = F.min(F.when(origin & boards(F.col("pickup_type")), F.col("stop_sequence"))).over(trip)
    later = times.withColumn("boarded", boarded).where(boards(F.col("drop_off_type")) & (F.col("stop_sequence") > F.col("boarded")))
    return later.groupBy(F.col("stop").alias("destination")).agg(F.count_distinct("trip_id").alias("trips"))

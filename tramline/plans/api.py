"""The service's questions over normalised tables, each one lazy plan.

``Tables`` holds frames by name, with a ``snapshot_id`` column each; the live
snapshot is taken from the one-row control table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions import geo, modes, text
from tramline.operators import mvt, normalise, poi, store


@dataclass
class Tables:
    frames: dict[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        """A table's rows of the live snapshot; the control table has one such row, so it is broadcast."""
        df = self.frames[name]
        if "snapshot_id" not in df.columns or name == "snapshots":
            return df
        live = self.frames["snapshots"].where("is_active").select(F.col("public_id").alias("snapshot_id")).limit(1)
        return df.join(F.broadcast(live), "snapshot_id", "left_semi")


def current_snapshot(t: Tables) -> DataFrame:
    s = t["snapshots"].where("is_active")
    if "sources" in t.frames:
        of = t.frames["sources"].select(F.col("source_key"), F.col("name").alias("source_name"), "license", "attribution")
        s = s.join(of, "source_key", "left")
    extra = [c for c in ("source_key", "source_name", "license", "attribution") if c in s.columns]
    report = lambda k: F.get_json_object("quality_report", f"$.{k}")
    return s.select("public_id", "status", "valid_from", "valid_until", report("stop_places").try_cast("long").alias("stop_places"), report("trips").try_cast("long").alias("trips"), *extra)


def search_stops(t: Tables, query: str = "", states: list[str] | None = None, wanted: list[str] | None = None, limit: int = 20) -> DataFrame:
    if not 1 <= limit <= 50:
        raise ValueError("limit lies in 1..50")
    s = t["stop_places"].where("is_display_stop")
    found = text.contains_pattern(F.col("name"), query) | text.contains_pattern(F.col("public_id"), query) | F.coalesce(text.contains_pattern(F.col("dhid"), query), F.lit(False)) if query else F.lit(True)
    return s.where(found & text.one_of(F.col("state_code"), states or []) & modes.has_mode(F.col("modes"), wanted or [])).orderBy("name", "public_id").limit(limit)


def _routes(t: Tables) -> DataFrame:
    """Routes, with a name of their agency where the import has none."""
    r = t["routes"]
    return r if "agency_name" in r.columns else r.withColumn("agency_name", F.lit(None).cast("string"))


def resolve(frame: DataFrame, column: str, public_id: str) -> DataFrame:
    """Rows of the first form of an id that is there."""
    names = text.id_aliases(public_id)
    rank = F.array_position(F.array(*map(F.lit, names)), F.col(column))
    rows = frame.where(F.col(column).isin(names)).withColumn("_rank", rank)
    return rows.join(rows.agg(F.min("_rank").alias("_rank")), "_rank", "left_semi").drop("_rank")


def stop_details(t: Tables, public_id: str, most: int = 100) -> DataFrame:
    """The stop and its routes, by short and long name, unnamed last."""
    stop = resolve(t["stop_places"], "public_id", public_id)
    serve = t["route_pattern_stops"].join(stop.select(F.col("public_id").alias("stop_place_id")), "stop_place_id", "left_semi").select("route_id", "stop_place_id").distinct()
    lines = serve.join(_routes(t).select("route_id", "short_name", "long_name", "mode", "color", "agency_name"), "route_id")
    lines = lines.select("stop_place_id", "route_id", "short_name", "long_name", "mode", modes.colour(F.col("color")).alias("color"), "agency_name").distinct()
    sort = F.array_sort(F.collect_list(F.struct(F.col("short_name").isNull().alias("a"), "short_name", F.col("long_name").isNull().alias("b"), "long_name", "route_id", "mode", "color", "agency_name")))
    kept = ("route_id", "short_name", "long_name", "mode", "color", "agency_name")
    listed = lines.groupBy(F.col("stop_place_id").alias("public_id")).agg(F.slice(F.transform(sort, lambda r: F.struct(*(r[c].alias(c) for c in kept))), 1, most).alias("routes"))
    return stop.join(listed, "public_id", "left")


def direct_trips(t: Tables, origin: str, date: str) -> DataFrame:
    """destination, trips: direct trips of one day from a place to each place."""
    day = t["service_dates"].where(F.col("is_active") & (F.col("service_date") == F.lit(date).cast("date"))).select("service_id")
    trips = t["trips"].join(day, "service_id", "left_semi")
    rows = t["stop_times"].withColumn("stop", F.col("stop_place_id"))
    return normalise.direct_connections(rows, F.col("stop") == origin, trips)


def stop_metrics(t: Tables, public_id: str, profile: str, origin: str | None = None, date: str | None = None) -> DataFrame:
    """The latest metric row of a stop under a profile, with the day's direct trips if a date is given."""
    rows = resolve(t["od_metrics"], "destination", public_id).where(F.col("profile") == profile)
    latest = store.first_wins(rows, ["destination"], [F.desc("computed_at"), F.col("metric_run_id")])
    if date is None:
        return latest
    return latest.join(direct_trips(t, origin, date).withColumnRenamed("trips", "direct_trips_of_day"), "destination", "left").withColumn("direct_trips_of_day", F.coalesce("direct_trips_of_day", F.lit(0)))


def route_pattern(t: Tables, pattern_id: str) -> DataFrame:
    """One pattern with the line to show, its trips and its stops in order."""
    p = t["route_patterns"].where(F.col("pattern_id") == pattern_id)
    if "rail_matches" in t.frames:
        m = t["rail_matches"].select("pattern_id", F.col("line").alias("osm"), "confidence")
        p = p.join(m, "pattern_id", "left")
        line, quality = modes.display_geometry(F.col("confidence"), F.col("osm"), F.col("line"), F.col("geometry_quality"))
        p = p.withColumns({"line": line, "geometry_quality": quality}).drop("osm")
    stops = t["route_pattern_stops"].where(F.col("pattern_id") == pattern_id).join(t["stop_places"].select(F.col("public_id").alias("stop_place_id"), "name", "lat", "lon"), "stop_place_id")
    listed = stops.groupBy("pattern_id").agg(F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_place_id", "name", "lat", "lon"))).alias("stops"))
    trips = t["trips"].where(F.col("pattern_id") == pattern_id).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("trip_count"))
    out = p.join(_routes(t).select("route_id", "short_name", "long_name", "mode", "agency_name"), "route_id").join(listed, "pattern_id", "left").join(trips, "pattern_id", "left")
    live = t["snapshots"].where("is_active").limit(1).select(F.col("public_id").alias("snapshot")) if "snapshots" in t.frames else None
    out = out.withColumns({"trip_count": F.coalesce("trip_count", F.lit(0)), "geojson": geo.geojson_line(F.col("line"))})
    return out if live is None else out.crossJoin(F.broadcast(live))  # one row


def list_places(t: Tables, query: str = "", categories: list[str] | None = None, states: list[str] | None = None, limit: int = 100) -> DataFrame:
    if not 1 <= limit <= 500:
        raise ValueError("limit lies in 1..500")
    found = text.contains_pattern(F.col("name"), query) | text.contains_pattern(F.coalesce("address", F.lit("")), query) if query else F.lit(True)
    rows = t["places"].where(F.col("deleted_at").isNull() & found & text.one_of(F.col("category"), categories or []) & text.one_of(F.col("state_code"), states or []))
    return rows.orderBy("name", "id").limit(limit)


PLACE_COLUMNS = "id string, name string, category string, state_code string, address string, website string, lon double, lat double, deleted_at timestamp"


def create_place(places: DataFrame, values: dict) -> tuple[DataFrame, DataFrame]:
    """(places with a new one, the new row); name, a known category and a position are needed, the id is made if absent."""
    import uuid

    if missing := [c for c in ("name", "category", "lon", "lat") if values.get(c) is None or values[c] == ""]:
        raise ValueError(f"a place needs {', '.join(missing)}")
    if values["category"] not in poi.PLACE_CATEGORIES:
        raise ValueError(f"unknown category {values['category']}")
    if not (-180 <= values["lon"] <= 180 and -90 <= values["lat"] <= 90):
        raise ValueError("the position lies outside the world")
    row = {c.split()[0]: values.get(c.split()[0]) for c in PLACE_COLUMNS.split(", ")} | {"id": values.get("id") or uuid.uuid4().hex, "deleted_at": None}
    row |= {"lon": float(row["lon"]), "lat": float(row["lat"])}
    new = places.sparkSession.createDataFrame([tuple(row.values())], PLACE_COLUMNS)
    return places.unionByName(new, allowMissingColumns=True), new


def delete_place(places: DataFrame, place: str, now: Column) -> DataFrame:
    return store.soft_delete(places, F.col("id") == place, now)


def snapshot_of(t: Tables, public_id: str | None = None) -> DataFrame:
    """The control row of the snapshot named, or of the live one."""
    return t.frames["snapshots"].where(F.col("is_active") if public_id is None else F.col("public_id") == public_id)


def checked_request(values: dict) -> dict:
    """A request's parameters with defaults, in range; raises ValueError else."""
    import re

    rules = {"limit": (1, 50, 20), "places_limit": (1, 500, 100), "z": (0, 22, None), "x": (0, 1 << 22, None), "y": (0, 1 << 22, None)}
    out = dict(values)
    for name, (low, high, default) in rules.items():
        if name in values or (default is not None and name.endswith("limit")):
            out[name] = int(values.get(name, default))
            if not low <= out[name] <= high:
                raise ValueError(f"{name} lies in {low}..{high}")
    for name, pattern in (("date", r"\d{4}-\d{2}-\d{2}"), ("time", r"([01]\d|2[0-3]):[0-5]\d")):
        if name in values and not re.fullmatch(pattern, values[name]):
            raise ValueError(f"{name} is malformed")
    if "z" in out and any(out.get(c, 0) >= 1 << out["z"] for c in "xy"):
        raise ValueError("the tile lies outside its zoom")
    return out


def update_place(places: DataFrame, place: str, values: dict) -> DataFrame:
    """State, address and website may be cleared by null; name, category and position keep theirs then."""
    if "category" in values and values["category"] not in (None, *poi.PLACE_CATEGORIES):
        raise ValueError(f"unknown category {values['category']}")
    return store.patch(places, F.col("id") == place, values, ("state_code", "address", "website"))


def _latest_metrics(t: Tables, profile: str) -> DataFrame:
    runs = t["metric_runs"].where(F.col("profile") == profile).orderBy(F.desc_nulls_last("completed_at"), F.desc("started_at")).limit(1)
    return t["od_metrics"].join(F.broadcast(runs.select(F.col("id").alias("metric_run_id"))), "metric_run_id", "left_semi").select(F.col("destination").alias("public_id"), "fastest_s", "median_s", "direct_count")


def _tile(rows: DataFrame, z: int, x: int, y: int) -> DataFrame:
    return rows.withColumns({"z": F.lit(z), "x": F.lit(x), "y": F.lit(y)})


def _in_tile(z: int, x: int, y: int) -> Column:
    return geo.in_box(F.col("lon"), F.col("lat"), geo.tile_degrees(z, x, y))


def _touches(line: str, z: int, x: int, y: int) -> Column:
    """Whether a line's box overlaps the tile's; the encoder clips exactly."""
    return geo.box_meets(F.col(line), geo.tile_degrees(z, x, y))


def stop_tile(t: Tables, z: int, x: int, y: int, wanted: list[str] | None = None, profile: str = "") -> DataFrame:
    """Stops of a tile with priority, travel time and, from zoom 9, their first five routes."""
    s = t["stop_places"].where(F.col("is_display_stop") & _in_tile(z, x, y) & modes.has_mode(F.col("modes"), wanted or []))
    if profile:
        s = s.join(_latest_metrics(t, profile), "public_id", "left")
    else:
        s = s.withColumns({"fastest_s": F.lit(None).cast("int"), "median_s": F.lit(None).cast("double"), "direct_count": F.lit(None).cast("long")})
    if z >= 9:
        serve = t["route_pattern_stops"].select("pattern_id", "stop_place_id").distinct().join(s.select(F.col("public_id").alias("stop_place_id")), "stop_place_id", "left_semi")
        labels = serve.join(t["route_patterns"].select("pattern_id", "route_id"), "pattern_id").join(t["routes"], "route_id").select("stop_place_id", text.route_label(F.col("short_name"), F.col("long_name"), F.col("route_id"), F.col("mode")).alias("label")).distinct()
        listed = labels.groupBy(F.col("stop_place_id").alias("public_id")).agg(F.array_sort(F.collect_set("label")).alias("l"))
        s = s.join(listed, "public_id", "left").withColumns({"routes": F.array_join(F.slice("l", 1, 5), ", "), "route_count": F.coalesce(F.size("l"), F.lit(0))})
    else:
        s = s.withColumns({"routes": F.lit(None).cast("string"), "route_count": F.lit(None).cast("int")})
    rows = s.withColumns({"points": F.array(F.struct("lon", "lat")), "stop_priority": modes.stop_priority(F.col("modes")), "is_bus_only": modes.is_bus_only(F.col("modes"))})
    return mvt.tiles(_tile(rows, z, x, y), "stops", ["public_id", "name", "stop_priority", "is_bus_only", "fastest_s", "median_s", "direct_count", "routes", "route_count"])


def route_tile(t: Tables, z: int, x: int, y: int, wanted: list[str] | None = None, profile: str = "") -> DataFrame:
    """Lines of bus and tram from zoom 9, and stop-pair segments of rail with their ends' travel times."""
    names = ["id", "mode", "route_color", "geometry_quality", "from_fastest_s", "to_fastest_s", "length_m"]
    lines = t["routes"].select("route_id", "mode", modes.colour(F.col("color")).alias("route_color")).where(text.one_of(F.col("mode"), wanted or []))
    places = t["stop_places"]
    if profile:
        places = places.join(_latest_metrics(t, profile).select("public_id", "fastest_s"), "public_id", "left")
    else:
        places = places.withColumn("fastest_s", F.lit(None).cast("int"))
    end = lambda side: places.select(F.col("public_id").alias(f"{side}_id"), F.col("fastest_s").alias(f"{side}_fastest_s"))
    seg = t["route_stop_segments"].join(lines.where(F.col("mode").isin(modes.RAIL_MODES)), "route_id").where(F.col("length_m") <= modes.line_cap(F.col("mode"))).join(end("from"), "from_id").join(end("to"), "to_id")
    points = F.array(F.struct(F.col("from_lon").alias("lon"), F.col("from_lat").alias("lat")), F.struct(F.col("to_lon").alias("lon"), F.col("to_lat").alias("lat")))
    rows = seg.withColumns({"points": points, "id": F.concat_ws(":", "route_id", "from_id", "to_id"), "geometry_quality": F.lit("stop_pair_segment")}).where(_touches("points", z, x, y)).select("points", *names)
    if z >= 9:
        other = t["route_patterns"].where(F.col("line").isNotNull()).join(lines.where(~F.col("mode").isin(modes.RAIL_MODES)), "route_id").select(F.col("line").alias("points"), F.col("pattern_id").alias("id"), "mode", "route_color", "geometry_quality", "length_m").where(_touches("points", z, x, y))
        rows = rows.unionByName(other.drop("length_m"), allowMissingColumns=True)
    return mvt.tiles(_tile(rows, z, x, y), "routes", names, 0.01 if z < 8 else 0.003 if z < 10 else 0.0)


def rail_tile(edges: DataFrame, z: int, x: int, y: int) -> DataFrame:
    rows = edges.select("edge_id", "is_service", F.col("line").alias("points")).where(_touches("points", z, x, y))
    return mvt.tiles(_tile(rows.withColumn("edge_id", F.col("edge_id").cast("string")), z, x, y), "rail", ["edge_id", "is_service"], 0.002 if z < 10 else 0.0)


def place_tile(places: DataFrame, z: int, x: int, y: int, layer: str = "places", categories: list[str] | None = None, states: list[str] | None = None) -> DataFrame:
    """Places or schools of a tile; deleted ones are left out."""
    live = F.col("deleted_at").isNull() if "deleted_at" in places.columns else F.lit(True)
    column = "category" if "category" in places.columns else "school_category"
    rows = places.where(live & _in_tile(z, x, y) & text.one_of(F.col(column), categories or []) & text.one_of(F.col("state_code"), states or []))
    return mvt.tiles(_tile(rows.withColumn("points", F.array(F.struct("lon", "lat"))), z, x, y), layer, ["name", column, "state_code"])

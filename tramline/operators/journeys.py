"""Nested journey documents to flat itineraries, and place matching by name and distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import flat_m
from tramline.functions.text import dice, german_name, location_score, stop_numbers
from tramline.functions.times import half_up, local_to_utc, seconds_between

PLACE = "struct<name:string>"
JOURNEY = (
    "struct<refreshToken:string, legs:array<struct<"
    f"origin:{PLACE}, destination:{PLACE}, departure:string, plannedDeparture:string, arrival:string, plannedArrival:string, "
    "departureDelay:int, arrivalDelay:int, departurePlatform:string, line:struct<name:string, mode:string, product:string>, "
    "direction:string, walking:boolean, cancelled:boolean, distance:double, remarks:array<struct<text:string, summary:string, code:string>>>>>"
)


def leg_type(leg: Column) -> Column:
    """transit with a line name, walk if walking, else transfer."""
    return F.when(leg["line"]["name"].isNotNull(), "transit").when(F.coalesce(leg["walking"], F.lit(False)), "walk").otherwise("transfer")


def leg_duration(leg: Column) -> Column:
    return seconds_between(F.coalesce(leg["departure"], leg["plannedDeparture"]), F.coalesce(leg["arrival"], leg["plannedArrival"]), clamp=True)


def sum_of(legs: Column, kind: str, empty: Column) -> Column:
    """Summed duration of the legs of a kind; empty where there is none."""
    found = F.filter(F.transform(F.filter(legs, lambda x: leg_type(x) == kind), leg_duration), lambda s: s.isNotNull())
    return F.when(F.size(found) == 0, empty).otherwise(F.aggregate(found, F.lit(0).cast("bigint"), lambda s, x: s + x))


def last_filled(values: Column) -> Column:
    found = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def remarks(legs: Column, most: int = 5) -> Column:
    """Texts of all legs' remarks, the first that is there of text, summary and code."""
    each = F.flatten(F.transform(legs, lambda x: F.transform(F.coalesce(x["remarks"], F.array().cast("array<struct<text:string,summary:string,code:string>>")), lambda r: F.coalesce(r["text"], r["summary"], r["code"]))))
    return F.slice(F.filter(each, lambda v: v.isNotNull()), 1, most)


def itineraries(journeys: DataFrame, column: str, requested: Column) -> DataFrame:
    """One row a journey (JSON text in column) with its derived times; legs without any time are left out."""
    j = F.from_json(F.col(column), JOURNEY)
    has_time = lambda x: F.coalesce(x["departure"], x["plannedDeparture"], x["arrival"], x["plannedArrival"]).isNotNull()
    df = journeys.withColumn("_legs", F.filter(j["legs"], has_time)).where("_legs is not null")
    legs = F.col("_legs")
    departure = F.transform(legs, lambda x: F.coalesce(x["departure"], x["plannedDeparture"]))
    arrival = last_filled(F.transform(legs, lambda x: F.coalesce(x["arrival"], x["plannedArrival"])))
    first = F.get(F.filter(departure, lambda v: v.isNotNull()), F.lit(0))
    rides = F.filter(legs, lambda x: leg_type(x) == "transit")
    none = F.lit(None).cast("bigint")
    return df.select(
        *journeys.columns,
        first.alias("departure_at"),
        arrival.alias("arrival_at"),
        seconds_between(first, arrival, clamp=True).alias("duration_s"),
        seconds_between(requested, first, clamp=True).alias("initial_wait_s"),
        F.greatest(F.size(rides) - 1, F.lit(0)).alias("transfers"),
        sum_of(legs, "transit", none).alias("in_vehicle_s"),
        sum_of(legs, "walk", none).alias("walk_s"),
        F.exists(legs, lambda x: F.coalesce(x["cancelled"], F.lit(False))).alias("cancelled"),
        F.get(F.transform(legs, lambda x: x["departureDelay"]), F.lit(0)).alias("departure_delay_s"),
        F.aggregate(legs, F.lit(0.0), lambda s, x: s + F.when(leg_type(x) == "walk", F.coalesce(x["distance"], F.lit(0.0))).otherwise(0.0)).alias("walk_m"),
        remarks(legs).alias("remarks"),
    )


def ranked(options: DataFrame, group: list[str], most: int = 4) -> DataFrame:
    """Options in order of arrival with their kind: the first arrives earliest, the others change least."""
    w = Window.partitionBy(*group).orderBy(F.col("arrival_at").asc_nulls_last(), "transfers", "departure_at")
    out = options.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < most)
    return out.withColumn("kind", F.when(F.col("rank") == 0, "earliest_arrival").otherwise("fewest_transfers"))


def match_places(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best candidate of each request, by name similarity and distance, the first of equal ones.

    wanted: request, name, lat, lon; candidates: request, position, id, name, lat, lon, distance.
    """
    a = wanted.select("request", german_name(F.col("name")).alias("_name"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    rows = candidates.join(a, "request")
    meters = F.coalesce("distance", flat_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")))
    score = location_score(dice(german_name(F.col("name")), F.col("_name")), meters)
    best = rows.withColumn("score", score).where("score is not null").groupBy("request").agg(F.max(F.struct("score", (-F.col("position")).alias("p"), "id")).alias("b"))
    return best.select("request", F.col("b.id").alias("id"), F.col("b.score").alias("score"))


HALT = "struct<name:string, abfahrt:struct<sollzeit:string,echtzeit:string,prognosezeit:string>, ankunft:struct<sollzeit:string,echtzeit:string,prognosezeit:string>>"
SECTIONS = (
    "struct<ctxRecon:string, verbindungsAbschnitte:array<struct<"
    f"startHalt:{HALT}, zielHalt:{HALT}, abfahrtsOrt:string, ankunftsOrt:string, abschnittsDauer:int, "
    "verkehrsmittel:struct<name:string,nummer:string,kategorie:string,produktGattung:string,typ:string,richtung:string>, "
    "halte:array<struct<gleis:string>>, originCancelled:boolean, destinationCancelled:boolean>>>"
)


def sections(journeys: DataFrame, column: str, zone: str = "Europe/Berlin") -> DataFrame:
    """One row a section of each journey of the second provider (JSON text in column), without those that have no time.

    Its times are local; they come out as UTC by the zone's rules.
    """
    j = F.from_json(F.col(column), SECTIONS)
    rows = journeys.select(*journeys.columns, F.posexplode(j["verbindungsAbschnitte"]).alias("sequence", "s"))
    s = F.col("s")
    at = lambda c: local_to_utc(c, zone)
    out, back = s["startHalt"]["abfahrt"], s["zielHalt"]["ankunft"]
    planned_out, planned_back = at(out["sollzeit"]), at(back["sollzeit"])
    left = F.coalesce(at(F.coalesce(out["echtzeit"], out["prognosezeit"])), planned_out)
    came = F.coalesce(at(F.coalesce(back["echtzeit"], back["prognosezeit"])), planned_back)
    v = s["verkehrsmittel"]
    name = F.nullif(F.concat_ws(" ", v["kategorie"], F.coalesce(v["name"], v["nummer"])), F.lit(""))
    seconds = lambda a, b: F.unix_seconds(b) - F.unix_seconds(a)
    return rows.select(
        *journeys.columns,
        (F.col("sequence") + 1).alias("sequence"),
        F.when(F.coalesce(v["name"], v["nummer"], v["kategorie"]).isNotNull(), "transit").otherwise("transfer").alias("leg_type"),
        F.coalesce(v["produktGattung"], v["typ"]).alias("mode"),
        name.alias("route_name"),
        F.coalesce(s["startHalt"]["name"], s["abfahrtsOrt"]).alias("from_name"),
        F.coalesce(s["zielHalt"]["name"], s["ankunftsOrt"]).alias("to_name"),
        left.alias("departure_at"),
        came.alias("arrival_at"),
        F.coalesce(s["abschnittsDauer"].cast("long"), F.when(seconds(left, came) >= 0, seconds(left, came))).alias("duration_s"),
        seconds(planned_out, left).alias("departure_delay_s"),
        seconds(planned_back, came).alias("arrival_delay_s"),
        F.get(s["halte"], F.lit(0))["gleis"].alias("platform_from"),
        F.element_at(s["halte"], -1)["gleis"].alias("platform_to"),
        (F.coalesce(s["originCancelled"], F.lit(False)) | F.coalesce(s["destinationCancelled"], F.lit(False))).alias("cancelled"),
    ).where("departure_at is not null or arrival_at is not null")


PLAN_PLACE = "struct<name:string, track:string>"
PLAN_LEG = f"struct<mode:string, displayName:string, routeShortName:string, agencyName:string, headsign:string, startTime:string, endTime:string, duration:bigint, distance:double, `from`:{PLAN_PLACE}, to:{PLAN_PLACE}>"
PLAN = f"struct<itineraries:array<struct<endTime:string, transfers:int, legs:array<{PLAN_LEG}>>>>"


def planned_options(plans: DataFrame, column: str, requested: Column, most: int = 4) -> DataFrame:
    """One row an option of a planner's answer (JSON text in column), the first so many: times, waits and distances derived from its legs.

    The first option is the earliest arrival, the others change least.  Sums
    over legs without values are 0, unlike those of live journeys.
    """
    options = F.slice(F.from_json(F.col(column), PLAN)["itineraries"], 1, most)
    rows = plans.withColumn("_requested", requested).select(*plans.columns, "_requested", F.posexplode(options).alias("rank", "o"))
    legs = F.coalesce(F.col("o")["legs"], F.array().cast(f"array<{PLAN_LEG}>"))
    rows = rows.withColumn("_legs", legs)
    walk = lambda x: F.coalesce(x["mode"], F.lit("")) == "WALK"
    rides = F.filter("_legs", lambda x: ~walk(x))
    first = F.get(rides, F.lit(0))["startTime"]
    at = F.array_position(F.transform("_legs", lambda x: ~walk(x)), True)
    total = lambda part, name, zero: F.aggregate(part, zero, lambda s, x: s + F.coalesce(x[name], zero))
    lead = F.when(at > 0, F.filter(F.slice("_legs", F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), walk)).otherwise(F.slice("_legs", 1, 0))
    to_first = F.unix_millis(F.try_to_timestamp(first)) - F.unix_millis(F.try_to_timestamp("_requested"))
    to_end = F.unix_millis(F.try_to_timestamp(F.col("o")["endTime"])) - F.unix_millis(F.try_to_timestamp("_requested"))
    none = F.lit(0).cast("bigint")
    initial = total(lead, "duration", none)
    return rows.select(
        *plans.columns,
        "rank",
        F.when(F.col("rank") == 0, "earliest_arrival").otherwise("fewest_transfers").alias("kind"),
        first.alias("departure_at"),
        F.col("o")["endTime"].alias("arrival_at"),
        F.greatest(half_up(to_end / 1000), F.lit(0)).alias("duration_s"),
        initial.alias("initial_walk_s"),
        F.greatest(half_up(to_first / 1000) - initial, F.lit(0)).alias("initial_wait_s"),
        total(rides, "duration", none).alias("in_vehicle_s"),
        total(F.filter("_legs", walk), "duration", none).alias("walk_s"),
        total(F.filter("_legs", walk), "distance", F.lit(0.0)).alias("walk_m"),
        F.coalesce(F.col("o")["transfers"], F.greatest(F.size(rides) - 1, F.lit(0))).alias("transfers"),
    )


def resolved_stops(stops: DataFrame, nearby: DataFrame, named: DataFrame, web: DataFrame | None = None) -> DataFrame:
    """public_id, location, how: the provider's id of each stop, by its own id, else nearby, else by name, else by web search.

    stops: public_id, name, lat, lon; the others: candidates as in match_places,
    request being the public_id.  A stop that nothing resolves has a null
    location and ``unmapped``.
    """
    wanted = stops.withColumnRenamed("public_id", "request")
    best = lambda c, how: match_places(wanted, c).select(F.col("request").alias("public_id"), F.col("id").alias(how))
    own = F.get(stop_numbers(F.col("public_id")), F.lit(0))
    out = stops.select("public_id", own.alias("direct"))
    names = ["direct", "nearby", "named"] + (["web"] if web is not None else [])
    for how, c in zip(names[1:], [nearby, named] + ([web] if web is not None else []), strict=True):
        out = out.join(best(c, how), "public_id", "left")
    how = F.lit("unmapped")
    for n in reversed(names):
        how = F.when(F.col(n).isNotNull(), n).otherwise(how)
    return out.select("public_id", F.coalesce(*names).alias("location"), how.alias("how"))

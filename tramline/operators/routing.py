"""Earliest arrivals on a schedule in rounds, one ride more in each, as joins over all departure samples at once.

A round finds the trips that the stops reached anew can board, and what these
trips reach from there; of the samples that could board a ride only the latest
does.  Samples, stops and trips are rows: no network is held on the driver or
in a task.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import haversine_m
from tramline.operators.normalise import boards
from tramline.plans.stages import release, stored

#: Seconds of a stretch of the day: stops are asked for departures by stretch, so that a busy stop is many keys.
STRETCH_S = 1800


def day_connections(times: DataFrame, trips: DataFrame | None, active: DataFrame) -> DataFrame:
    """date, trip, a, b, dep, arr, board, alight of every ride between neighbouring stops on the days of active.

    active: date, service_id and day_offset, 0 for the services of that date
    and 1 for those of the day before, whose times past midnight count less 24
    hours.  Without trips all of them run on all rows of active.  Rides that
    begin before midnight or arrive before they depart are left out.
    """
    shift = (F.col("day_offset") * -86400).alias("shift")
    order = Window.partitionBy("trip_id").orderBy("stop_sequence")
    nxt = lambda c: F.lead(c).over(order)
    rides = times.where("arrival_s is not null or departure_s is not null").select(
        "trip_id",
        F.col("stop_id").alias("a"),
        nxt("stop_id").alias("b"),
        F.coalesce("departure_s", "arrival_s").alias("dep"),
        nxt(F.coalesce("arrival_s", "departure_s")).alias("arr"),
        boards(F.col("pickup_type")).alias("board"),
        boards(nxt("drop_off_type")).alias("alight"),
    )
    # a trip's rides are found once, whatever the number of its dates
    rows = rides.where("b is not null and arr >= dep")
    if trips is None:
        rows = rows.crossJoin(active.select("date", shift))
    else:
        rows = rows.join(trips.join(active, "service_id").select("date", "trip_id", shift), "trip_id")
    trip = F.concat_ws("@", "trip_id", "shift").alias("trip")
    return rows.select("date", trip, "a", "b", (F.col("dep") + F.col("shift")).alias("dep"), (F.col("arr") + F.col("shift")).alias("arr"), "board", "alight").where("dep >= 0")


def _front(offers: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """date, stop, sample, at, fresh: of offers (date, stop, sample, at) and what is known, those that no later sample matches; fresh are the ones that known lacks."""
    rows = offers.select("date", "stop", "sample", "at", F.lit(True).alias("fresh"))
    if known is not None:
        rows = rows.unionByName(known.withColumn("fresh", F.lit(False)))
    once = rows.groupBy("date", "stop", "sample").agg(F.min(F.struct("at", "fresh")).alias("x")).select("date", "stop", "sample", "x.*")
    later = Window.partitionBy("date", "stop").orderBy(F.desc("sample")).rowsBetween(Window.unboundedPreceding, -1)
    return once.withColumn("_best", F.min("at").over(later)).where("_best is null or at < _best").drop("_best")


def reach(samples: DataFrame, connections: DataFrame, walks: DataFrame, origins: list[str], horizon: int = 7200, change: int = 0, round_to_minute: bool = False, store=stored) -> DataFrame:
    """date, sample, stop, seconds, legs, position: the earliest arrival in a vehicle within the horizon at each stop, and its fewest rides.

    samples: date, sample (its start in seconds of the day); walks:
    from_stop_id, to_stop_id, seconds.  A walk may begin a way or follow a
    ride, but not end the way; between two rides at one stop lie change seconds,
    between two stops the walk.  A trip is ridden in the order of its departures
    (then arrivals), from where it is boarded on.  position numbers the stops
    of a sample by name.  store(df) writes a frame and returns it reread.

    A way that starts at a later sample is open to all earlier ones, who wait
    at the origin for it.  So each ride is given to the latest sample that
    catches it alone, and earlier samples take over what they lack at the end:
    a round costs as many rows as rides are touched, whatever the number of samples.
    """
    key = ["date", "sample"]
    rides = connections if getattr(connections, "_stored_at", None) else store(connections)
    boardable = rides.where("board").select("date", F.col("a").alias("stop"), "trip", "dep", "arr")
    alighting = rides.where("alight").select("date", "trip", F.col("b").alias("stop"), "dep", "arr")
    foot = walks.where("from_stop_id != to_stop_id").groupBy(F.col("from_stop_id").alias("stop"), F.col("to_stop_id").alias("to")).agg(F.min("seconds").alias("walk"))
    until = F.col("sample") + horizon

    def on_foot(at: DataFrame) -> DataFrame:
        return at.join(foot, "stop").select(*key, F.col("to").alias("stop"), (F.col("at") + F.col("walk")).alias("at"))

    grid = samples.select("date", F.col("sample").cast("long").alias("sample")).distinct()
    begun = grid.select(*key, F.explode(F.array(*(F.lit(o) for o in origins))).alias("stop"), F.col("sample").alias("at"))
    ready = store(_front(begun.unionByName(on_foot(begun))))
    rounds: list[DataFrame] = []
    while ready.where("fresh").limit(1).count():
        # at most one entry a sample of the date
        fronts = ready.groupBy("date", "stop").agg(F.collect_list(F.struct("at", "sample", "fresh")).alias("front"), F.bool_or("fresh").alias("any")).where("any").drop("any")
        caught = F.array_max(F.transform(F.filter("front", lambda x: x.at <= F.col("dep")), lambda x: F.struct(x.sample.alias("sample"), x.fresh.alias("fresh"))))
        on = boardable.join(fronts, ["date", "stop"]).select("date", "trip", "dep", "arr", caught.alias("caught")).where("caught.fresh")
        on = on.select("date", "trip", "dep", "arr", "caught.sample").where(F.col("dep") <= until)
        on = on.groupBy("date", "trip").agg(F.collect_list(F.struct("dep", "arr", "sample")).alias("boarded"))
        this = F.struct("dep", "arr")
        aboard = F.array_max(F.transform(F.filter("boarded", lambda x: F.struct(x.dep.alias("dep"), x.arr.alias("arr")) <= this), lambda x: x.sample))
        out = alighting.join(on, ["date", "trip"]).select("date", "stop", "arr", aboard.alias("sample")).where(F.col("arr") <= until)
        out = store(out.groupBy("date", "stop", "sample").agg(F.min("arr").alias("at")))
        rounds.append(out.withColumn("legs", F.lit(len(rounds) + 1)))
        offers = out.withColumn("at", F.col("at") + change).unionByName(on_foot(out)).where(F.col("at") <= until)
        last, ready = ready, store(_front(offers, ready))
        release(last)
    release(ready, rides if rides is not connections else None)
    if not rounds:
        rounds = [begun.where("false").withColumn("legs", F.lit(0))]
    labels = functools.reduce(DataFrame.unionByName, rounds).groupBy("date", "stop", "sample").agg(F.min(F.struct("at", "legs")).alias("best"))
    numbered = grid.withColumn("i", F.row_number().over(Window.partitionBy("date").orderBy("sample")))
    down = Window.partitionBy("date", "stop").orderBy(F.desc("i"))
    spans = labels.join(numbered, key).select("date", "stop", "i", F.min("best").over(down).alias("best"), (F.coalesce(F.lead("i").over(down), F.lit(0)) + 1).alias("first"))
    each = spans.select("date", "stop", "best", F.explode(F.sequence("first", "i")).alias("i")).join(numbered, ["date", "i"]).where(F.col("best.at") <= until)
    seconds = F.col("best.at") - F.col("sample")
    position = F.row_number().over(Window.partitionBy(*key).orderBy("stop")) - 1
    return each.select(*key, "stop", (F.floor(seconds / 60 + 0.5) * 60 if round_to_minute else seconds).cast("int").alias("seconds"), F.col("best.legs").alias("legs"), position.alias("position"))


def not_dominated(options: DataFrame, group: list[str], key: str, criteria: list[str], strict: bool = False) -> DataFrame:
    """Rows that no other row of their group matches or beats on every criterion, smaller being better.

    A null arrival (the second criterion) is never dominated and dominates
    nothing; other nulls count as infinite.  Equal rows remove each other, or
    with strict one must be better in something.
    """
    worst = lambda c: F.coalesce(c.cast("double"), F.lit(float("inf")))
    a, b = options.alias("a"), options.alias("b")
    on = F.lit(True)
    for g in group:
        on = on & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    on = on & ~F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")) & F.col(f"a.{criteria[1]}").isNotNull() & F.col(f"b.{criteria[1]}").isNotNull()
    better = F.lit(False)
    for c in criteria:
        on = on & (worst(F.col(f"b.{c}")) <= worst(F.col(f"a.{c}")))
        better = better | (worst(F.col(f"b.{c}")) < worst(F.col(f"a.{c}")))
    return a.join(b, on & better if strict else on, "left_anti")


def two_leg_arrivals(times: DataFrame, origin, change_s: int = 0) -> DataFrame:
    """stop, arrival_s: earliest arrival with at most one change, from rides of times (trip_id, stop_sequence, stop, departure_s, arrival_s).

    A later stop of a trip is reached if its arrival is not before the earliest
    departure at which the trip could be boarded further up, which a running
    minimum along the trip tells without pairing its stops.
    """
    before = Window.partitionBy("trip_id").orderBy("stop_sequence").rowsBetween(Window.unboundedPreceding, -1)

    def ridden(rows: DataFrame) -> DataFrame:
        """Earliest arrival per stop, of rows with the departure at which each may be boarded (dep, null if not)."""
        touched = rows.withColumn("since", F.min("dep").over(before))
        return touched.where("since <= arrival_s").groupBy("stop").agg(F.min("arrival_s").alias("arrival_s"))

    start = times.withColumn("a", F.col("stop"))
    first = ridden(start.withColumn("dep", F.when(origin, F.col("departure_s"))))
    # the earliest arrival at a change is the only one that matters, so the second leg joins one row a stop
    at = first.select("stop", (F.col("arrival_s") + change_s).alias("ready"))
    second = ridden(times.join(at, "stop", "left").withColumn("dep", F.when(F.col("departure_s") >= F.col("ready"), F.col("departure_s"))))
    return first.unionByName(second).groupBy("stop").agg(F.min("arrival_s").alias("arrival_s"))


def estimated_drive(lon1, lat1, lon2, lat2, detour: float = 1.3, kmh: float = 70.0):
    """(metres, seconds) of a drive, by the straight distance and a usual detour and speed: an estimate, no route."""
    meters = haversine_m(lon1, lat1, lon2, lat2) * detour
    return meters, meters / (kmh / 3.6)

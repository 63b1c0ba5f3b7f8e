"""Itineraries between two stops: all that no other one matches in departure, arrival, changes and walking.

Labels are searched in rounds of one ride more, for all questions at once.  A
label at a stop says when its way departed, when it arrives and how far it
walked; one that another at the stop matches or beats, with no more rides, is
left out, and so is one that an itinerary already found does.  The rides that
come to the destination are found first: labels that are too late for one of
them before the last ride are left out, and the last ride is one of them.
Rides come from day_connections in routing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.routing import STRETCH_S
from tramline.plans.stages import release, stored

LEG = "struct<trip:string,origin:string,destination:string,departure:bigint,arrival:bigint>"


def _not_beaten(labels: DataFrame, group: list[str], others: DataFrame | None = None) -> DataFrame:
    """Labels (group, dep, arr, walk, legs) that no other of the group, nor any of others, matches in all and beats in something; of equal ones the first by its legs."""
    once = labels.groupBy(*group, "dep", "arr", "walk").agg(F.min("legs").alias("legs"))
    # of those that walk alike, one departing no later must arrive earlier than all that depart later
    later = Window.partitionBy(*group, "walk").orderBy(F.desc("dep"), "arr").rowsBetween(Window.unboundedPreceding, -1)
    kept = once.withColumn("_best", F.min("arr").over(later)).where("_best is null or arr < _best").drop("_best")
    a, b = kept.alias("a"), kept.alias("b")
    same = F.lit(True)
    for g in group:
        same = same & (F.col(f"a.{g}") == F.col(f"b.{g}"))
    beats = (F.col("b.dep") >= F.col("a.dep")) & (F.col("b.arr") <= F.col("a.arr")) & (F.col("b.walk") < F.col("a.walk"))
    out = a.join(b, same & beats, "left_anti")
    return out if others is None else _without(out, others, group)


def _without(labels: DataFrame, others: DataFrame, group: list[str]) -> DataFrame:
    """Labels that none of others, with fewer rides or on their way's end, matches or beats."""
    a, b = labels.alias("a"), others.select(*group, "dep", "arr", "walk").alias("b")
    on = (F.col("b.dep") >= F.col("a.dep")) & (F.col("b.arr") <= F.col("a.arr")) & (F.col("b.walk") <= F.col("a.walk"))
    for g in group:
        on = on & (F.col(f"a.{g}") == F.col(f"b.{g}"))
    return a.join(b, on, "left_anti")


def _stretch(c: Column) -> Column:
    return F.floor(c / STRETCH_S).cast("int")


def search(asked: DataFrame, connections: DataFrame, walks: DataFrame, horizon: int = 7200, change: int = 0, most_rides: int = 4, store=stored) -> DataFrame:
    """query, departure, arrival, changes, walk_s, legs of the questions (query, date, origin, destination, after, before).

    A way departs from after to before and arrives within the horizon after
    ``after``.  It may walk from its origin to its first stop, between two
    rides, and to its destination (walks: from_stop_id, to_stop_id, seconds,
    one at a time); between two rides at one stop lie change seconds.  Walks
    without a ride are no answer.  Origin and destination that are equal have
    no itineraries.
    """
    q = store(asked.where("origin != destination").select("query", "date", "origin", "destination", F.col("after").cast("long").alias("after"), F.col("before").cast("long").alias("before")))
    rides = store(connections)
    boardable = rides.where("board").select("date", F.col("a").alias("stop"), _stretch(F.col("dep")).alias("stretch"), "trip", F.col("dep").alias("c_dep"), F.col("arr").alias("c_arr"))
    alighting = rides.where("alight").select("date", "trip", F.col("b").alias("stop"), F.col("dep").alias("c_dep"), F.col("arr").alias("c_arr"))
    foot = walks.where("from_stop_id != to_stop_id").groupBy(F.col("from_stop_id").alias("stop"), F.col("to_stop_id").alias("to")).agg(F.min("seconds").cast("long").alias("seconds"))
    until = F.col("after") + horizon
    none = F.array().cast(f"array<{LEG}>")

    begun = q.select("query", F.col("origin").alias("stop"), F.lit(0).cast("long").alias("walk"))
    begun = begun.unionByName(begun.join(foot, "stop").select("query", F.col("to").alias("stop"), F.col("seconds").alias("walk")))
    # dep is null until a first ride is boarded
    ready = store(begun.join(q.select("query", "after"), "query").select("query", "stop", F.lit(None).cast("long").alias("dep"), (F.col("after") + F.col("walk")).alias("at"), "walk", none.alias("legs")))
    # what the last ride can be: rides by which a trip comes to the destination, or to a walk there, in time
    goals = q.select("query", F.col("destination").alias("stop"), F.lit(0).cast("long").alias("rest"))
    goals = goals.unionByName(goals.join(foot.select(F.col("to").alias("stop"), F.col("stop").alias("near"), "seconds"), "stop").select("query", F.col("near").alias("stop"), F.col("seconds").alias("rest")))
    goals = goals.join(q.select("query", "date", "after", "before"), "query").groupBy("query", "date", "after", "before", "stop").agg(F.min("rest").alias("rest"))
    goals = store(goals)
    ending = alighting.join(goals, ["date", "stop"]).where((F.col("c_dep") >= F.col("after")) & (F.col("c_arr") + F.col("rest") <= until))
    ending = ending.groupBy("query", "date", "after", "trip").agg(F.max(F.struct("c_dep", "c_arr")).alias("upto"))
    closing = ending.join(boardable, ["date", "trip"]).where((F.col("c_dep") >= F.col("after")) & (F.struct("c_dep", "c_arr") <= F.col("upto")))
    closing = store(closing.select("query", "stop", "stretch", "trip", "c_dep", "c_arr"))
    # the latest time at which one can be ready at a stop and still come to the destination by one ride more
    ready_by = closing.groupBy("query", "stop").agg(F.max("c_dep").alias("by"))
    on_time = ready_by.select("query", "stop", (F.col("by") - change).alias("by"))
    on_time = on_time.unionByName(ready_by.join(foot.select(F.col("to").alias("stop"), F.col("stop").alias("near"), "seconds"), "stop").select("query", F.col("near").alias("stop"), (F.col("by") - F.col("seconds")).alias("by")))
    at_goal = goals.select("query", "stop", (until - F.col("rest")).alias("by"))
    by_now = {0: at_goal, 1: on_time.unionByName(at_goal)}
    by_now = {left: store(rows.groupBy("query", "stop").agg(F.max("by").alias("by"))) for left, rows in by_now.items()}
    seen = found = None
    for ride in range(1, most_rides + 1):
        left = most_rides - ride
        at = ready.join(q.select("query", "date", "after", "before"), "query")
        at = at.withColumn("stretch", F.explode(F.sequence(_stretch(F.col("at")), F.greatest(_stretch(F.col("at")), _stretch(until)))))
        # stored, so that its size is known before rides are moved; a last ride is one of the closing ones
        at = store(at)
        on = (at.join(boardable, ["date", "stop", "stretch"]) if left else at.join(closing, ["query", "stop", "stretch"])).where((F.col("c_dep") >= F.col("at")) & (F.col("c_dep") <= until))
        dep = F.coalesce("dep", F.col("c_dep") - F.col("walk"))
        on = on.where(dep <= F.col("before")).select("query", "date", "after", "trip", dep.alias("dep"), "walk", F.struct("c_dep", "c_arr").alias("since"), "legs", "stop")
        # a trip boarded earlier, by a way that departs no earlier and walks no more, is the better one
        on = on.groupBy("query", "date", "after", "trip", "dep", "walk").agg(F.min(F.struct("since", "legs", "stop")).alias("x")).select("query", "date", "after", "trip", "dep", "walk", "x.*")
        later = Window.partitionBy("query", "trip", "walk").orderBy(F.desc("dep")).rowsBetween(Window.unboundedPreceding, -1)
        on = on.withColumn("_best", F.min("since").over(later)).where("_best is null or since < _best").drop("_best").withColumnRenamed("stop", "origin")
        out = on.join(alighting, ["date", "trip"]).where((F.struct("c_dep", "c_arr") >= F.col("since")) & (F.col("c_arr") <= until))
        leg = F.struct("trip", "origin", F.col("stop").alias("destination"), F.col("since.c_dep").alias("departure"), F.col("c_arr").alias("arrival"))
        out = out.select("query", "stop", "dep", F.col("c_arr").alias("arr"), "walk", F.concat("legs", F.array(leg)).alias("legs"))
        if left in by_now:  # what comes too late for the rides left beats nothing that does not
            out = out.join(by_now[left], ["query", "stop"]).where("arr <= by").drop("by")
        labels = store(_not_beaten(out, ["query", "stop"], seen))
        release(at)
        # itineraries end here, or a walk further
        ends = q.select("query", F.col("destination").alias("stop"), "after")
        walked = labels.join(foot, "stop").select("query", F.col("to").alias("stop"), "dep", (F.col("arr") + F.col("seconds")).alias("arr"), (F.col("walk") + F.col("seconds")).alias("walk"), "legs")
        done = labels.unionByName(walked).join(ends, ["query", "stop"]).where(F.col("arr") <= until).select("query", "dep", "arr", "walk", "legs")
        done = _not_beaten(done, ["query"], None if found is None else found)
        last, found = found, store((done if found is None else found.drop("rides").unionByName(done)).withColumn("rides", F.size("legs")))
        release(last)
        last, seen = seen, store(labels if seen is None else seen.unionByName(labels))
        release(last)
        if not left:
            release(labels)
            break
        open_ = _without(labels, found, ["query"])
        same = open_.select("query", "stop", "dep", (F.col("arr") + change).alias("at"), "walk", "legs")
        onward = open_.join(foot, "stop").select("query", F.col("to").alias("stop"), "dep", (F.col("arr") + F.col("seconds")).alias("at"), (F.col("walk") + F.col("seconds")).alias("walk"), "legs")
        last, ready = ready, store(same.unionByName(onward))
        release(last, labels)
        if not ready.limit(1).count():
            break
    release(rides, ready, seen, goals, closing, *by_now.values())
    return found.select("query", F.col("dep").alias("departure"), F.col("arr").alias("arrival"), (F.col("rides") - 1).alias("changes"), F.col("walk").alias("walk_s"), "legs")

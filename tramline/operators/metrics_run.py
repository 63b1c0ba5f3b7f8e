"""A metric run: samples of a profile from one origin, reduced to a row for each target place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.times import sample_seconds
from tramline.operators import metrics, routing
from tramline.operators import store as changes
from tramline.plans.stages import release, stored


@dataclass
class Profile:
    """Departures sampled from start to end (seconds of the day) of some dates, and how long a trip may take."""

    id: str
    dates: list[str]
    start_s: int
    end_s: int
    interval_s: int
    max_trip_s: int


def sample_times(spark, profile: Profile) -> DataFrame:
    """date, sample of each departure of a profile, numbered in order (position)."""
    per_day = len(range(profile.start_s, profile.end_s, profile.interval_s))
    rows = spark.createDataFrame([(d, i) for i, d in enumerate(sorted(profile.dates))], "date string, day int")
    out = rows.select("date", "day", F.posexplode(sample_seconds(profile.start_s, profile.end_s, profile.interval_s)).alias("i", "sample"))
    return out.select("date", "sample", (F.col("day") * per_day + F.col("i")).alias("position"))


def check_dates(samples: DataFrame, valid_from: str | None, valid_until: str | None) -> None:
    """Raise if a sample lies outside the snapshot's validity, or if there is none."""
    r = samples.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    if r.a is None:
        raise ValueError("the profile gives no samples")
    if (valid_from and r.a < valid_from) or (valid_until and r.b > valid_until):
        raise ValueError(f"samples from {r.a} to {r.b} lie outside {valid_from} to {valid_until}")


def check_origin(connections: DataFrame, origins: list[str]) -> None:
    """Raise unless some ride of every sampled date leaves or reaches the origin: what the run's first question must echo."""
    here = F.col("a").isin(origins) | F.col("b").isin(origins)
    without = connections.groupBy("date").agg(F.bool_or(here).alias("found")).where("not found").select("date").collect()  # one row a date of the profile
    if without:
        raise ValueError(f"no rides at {', '.join(origins)} on {', '.join(sorted(str(r.date) for r in without))}")


def active_services(service_dates: DataFrame, samples: DataFrame) -> DataFrame:
    """date, service_id, day_offset: the services of each sampled date, and those of the day before; of service_dates (service_id, service_date, is_active)."""
    dates = samples.select("date").distinct()
    runs = service_dates.where("is_active").select("service_id", F.explode(F.array(F.struct(F.col("service_date").alias("date"), F.lit(0).alias("day_offset")), F.struct(F.date_add("service_date", 1).alias("date"), F.lit(1).alias("day_offset")))).alias("r"))
    return runs.select(F.col("r.date").cast("string").alias("date"), "service_id", "r.day_offset").join(dates, "date", "left_semi").distinct()


def wall_clock(date: Column, seconds: Column) -> Column:
    """Seconds of the wall clock since 1970: one scale for samples of several dates."""
    return F.unix_date(date.cast("date")).cast("long") * 86400 + seconds


def arrivals_at_places(reached: DataFrame, stops: DataFrame) -> DataFrame:
    """Arrivals (sample, stop, seconds, legs, position) with the place of their stop (stop_id, stop_place_id); those of unknown stops are left out."""
    return reached.join(stops.select(F.col("stop_id").alias("stop"), F.col("stop_place_id").alias("place")), "stop")


def targets(places: DataFrame, states: list[str]) -> DataFrame:
    """Display stops in the states, as place."""
    return places.where(F.col("state_code").isin(states) & F.col("is_display_stop")).select(F.col("public_id").alias("place"))


def metric_rows(reached: DataFrame, stops: DataFrame, wanted: DataFrame, profile: Profile, run: str, origin: str, samples: int) -> DataFrame:
    """The run's row for each target: see metrics.service_summary."""
    arrivals = arrivals_at_places(reached, stops).join(wanted, "place", "left_semi")
    best = metrics.best_per_place(arrivals, profile.max_trip_s)
    out = metrics.service_summary(wanted, best, samples).withColumnRenamed("place", "destination")
    return out.withColumns({"metric_run_id": F.lit(run), "profile": F.lit(profile.id), "origin": F.lit(origin)})


def sample_log(reached: DataFrame, engine: str, version: str) -> DataFrame:
    """requested, engine, version and how many places each sample reached, as its line of the raw log."""
    n = reached.groupBy("sample").agg(F.count_distinct("stop").alias("reachable"))
    return n.select("sample", F.lit(engine).alias("engine"), F.lit(version).alias("version"), "reachable")


def write_log(samples: DataFrame, path: str) -> str:
    """Write the raw log as compressed JSON lines; the SHA-256 over its rows in order of sample."""
    changes.write_samples(samples, path)
    lines = samples.select(F.to_json(F.struct(*samples.columns)).alias("line"), "sample")
    digests = lines.groupBy().agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(F.lpad(F.col("sample").cast("string"), 10, "0"), F.sha2("line", 256)))), "\n"), 256).alias("d"))
    return digests.first().d  # one line a sample, and a few hundred samples a run


def write_run(rows: DataFrame, base: str) -> None:
    """Store a run's rows in the place of those with its id."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric_run_id").parquet(f"{base}/od_metrics")


def finished(runs: DataFrame, run: str, ok: bool, report: Column, now: Column) -> DataFrame:
    """Runs with one completed or failed, its report merged in; other running ones become failed."""
    mine = F.col("id") == run
    done = changes.supersede_runs(runs, run, now)
    return done.withColumns(
        {
            "status": F.when(mine, F.lit("completed" if ok else "failed")).otherwise(F.col("status")),
            "completed_at": F.when(mine, now).otherwise(F.col("completed_at")),
            "configuration": F.when(mine, changes.merged_report(F.col("configuration"), report)).otherwise(F.col("configuration")),
        }
    )


def run_profile(times: DataFrame, trips: DataFrame, service_dates: DataFrame, walks: DataFrame, stops: DataFrame, wanted: DataFrame, profile: Profile, run: str, origin: str, origins: list[str], change: int = 0, store=stored) -> DataFrame:
    """All samples of all dates of a profile, reduced to a row for each target.

    first_sample and last_sample, and the widest gap, are on one scale over the
    dates: seconds of the wall clock since 1970.
    """
    samples = sample_times(stops.sparkSession, profile)
    connections = store(routing.day_connections(times, trips, active_services(service_dates, samples)))
    check_origin(connections, origins)
    reached = routing.reach(samples, connections, walks, origins, profile.max_trip_s, change, round_to_minute=True, store=store)
    release(connections)
    reached = reached.withColumn("sample", wall_clock(F.col("date"), F.col("sample")))
    return metric_rows(reached, stops, wanted, profile, run, origin, len(profile.dates) * len(range(profile.start_s, profile.end_s, profile.interval_s)))

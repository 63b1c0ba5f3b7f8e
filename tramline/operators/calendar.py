"""Service calendars: weekly patterns and exceptions to one row per service and date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.times import days_between, gtfs_date, weekday_flag

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def service_dates(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """service_id, service_date, is_active, source.

    A weekly pattern gives the dates of its range on its weekdays, all active.
    An exception of type 1 adds a date, one of type 2 keeps it as inactive;
    of several for a service and date the largest type counts.
    """
    span = days_between(gtfs_date(F.col("start_date")), gtfs_date(F.col("end_date")))
    weekly = calendar.select("service_id", *DAYS, F.explode(span).alias("service_date")).where(weekday_flag(F.col("service_date"), [F.col(d) for d in DAYS]) == "1").select("service_id", "service_date").distinct()
    kind = F.col("exception_type").try_cast("int")
    changes = exceptions.select("service_id", gtfs_date(F.col("date")).alias("service_date"), kind.alias("kind")).where("service_date is not null and kind in (1, 2)").groupBy("service_id", "service_date").agg(F.max("kind").alias("kind"))
    both = weekly.withColumn("weekly", F.lit(True)).join(changes, ["service_id", "service_date"], "full")
    return both.select("service_id", "service_date", F.coalesce(F.col("kind") == 1, F.lit(True)).alias("is_active"), F.when(F.col("kind").isNotNull(), "calendar_dates").otherwise("calendar").alias("source"))


def validity(dates: DataFrame) -> DataFrame:
    """First and last active date, and the number of all rows."""
    active = F.when(F.col("is_active"), F.col("service_date"))
    return dates.agg(F.min(active).alias("valid_from"), F.max(active).alias("valid_until"), F.count(F.lit(1)).alias("rows"))

"""Schedule feeds: archives, staging tables, validation and inspection."""

from __future__ import annotations

import hashlib
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.functions.text import blank_to_null, squeezed
from tramline.functions.times import gtfs_seconds

#: Columns of each member that later steps read; files may lack some of them, or be missing as a whole if optional.
MEMBERS = {
    "agency": "agency_id agency_name agency_url agency_timezone agency_lang",
    "stops": "stop_id stop_name stop_lat stop_lon location_type parent_station platform_code wheelchair_boarding",
    "routes": "route_id agency_id route_short_name route_long_name route_type route_color route_text_color",
    "trips": "route_id service_id trip_id trip_headsign direction_id block_id shape_id wheelchair_accessible bikes_allowed",
    "stop_times": "trip_id arrival_time departure_time stop_id stop_sequence pickup_type drop_off_type shape_dist_traveled timepoint",
    "calendar": "service_id monday tuesday wednesday thursday friday saturday sunday start_date end_date",
    "calendar_dates": "service_id date exception_type",
    "shapes": "shape_id shape_pt_lat shape_pt_lon shape_pt_sequence shape_dist_traveled",
    "transfers": "from_stop_id to_stop_id transfer_type min_transfer_time",
    "pathways": "pathway_id from_stop_id to_stop_id pathway_mode is_bidirectional length traversal_time",
    "feed_info": "feed_publisher_name feed_publisher_url feed_lang feed_start_date feed_end_date feed_version",
}
REQUIRED = ("agency", "stops", "routes", "trips", "stop_times")
MARKER = ".extract-complete"


def extract_feed(archive: str, folder: str) -> str:
    """Unpack the known members of a ZIP, folders inside it left off; a finished folder is left alone."""
    if os.path.exists(marker := os.path.join(folder, MARKER)):
        return folder
    os.makedirs(folder, exist_ok=True)
    with zipfile.ZipFile(archive) as z:
        if bad := z.testzip():
            raise ValueError(f"{archive}: {bad} is damaged")
        for info in z.infolist():
            name = os.path.basename(info.filename)
            if name.removesuffix(".txt") in MEMBERS and name.endswith(".txt"):
                with z.open(info) as src, open(os.path.join(folder, name), "wb") as out:
                    while chunk := src.read(1 << 20):
                        out.write(chunk)
    open(marker, "w").close()
    return folder


def has_broken_rows(spark: SparkSession, path: str) -> bool:
    """Whether some line of a file holds an odd number of quotes, so that a quoted value runs over its end."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return spark.read.text(path).where(quotes % 2 == 1).limit(1).count() > 0


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV with header, all columns text; a byte-order mark is taken off the first name.

    Quotes inside quoted values are doubled.  Only a file in which a quoted
    value holds a line break is read as one split.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, sep=sep, encoding="UTF-8", quote='"', escape='"', multiLine=has_broken_rows(spark, path))
    return df.toDF(*(c.lstrip("\ufeff").strip().strip('"') for c in df.columns))


def pad(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame with every named column, missing ones null text."""
    return df.withColumns({c: F.lit(None).cast("string") for c in columns if c not in df.columns})


def read_feed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Staging tables of a feed, all text; a missing optional file is an empty table."""
    out, missing = {}, []
    for name, columns in MEMBERS.items():
        path, want = os.path.join(folder, f"{name}.txt"), columns.split()
        if os.path.exists(path):
            out[name] = pad(read_csv(spark, path), want)
        elif name in REQUIRED:
            missing.append(name)
        else:
            out[name] = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in want]))
    if missing:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    if not os.path.exists(os.path.join(folder, "calendar.txt")) and not os.path.exists(os.path.join(folder, "calendar_dates.txt")):
        raise FileNotFoundError(f"{folder} lacks a calendar")
    return out


def validate_folder(folder: str) -> str:
    """SHA-256 over names and contents of the feed's files, in order of name; raises if a required file is missing."""
    names = sorted(n for n in os.listdir(folder) if n.endswith(".txt"))
    if missing := {f"{m}.txt" for m in REQUIRED} - set(names):
        raise FileNotFoundError(f"{folder} lacks {', '.join(sorted(missing))}")
    total = hashlib.sha256()
    for n in names:
        total.update(n.encode())
        with open(os.path.join(folder, n), "rb") as f:
            while chunk := f.read(1 << 20):
                total.update(chunk)
    return total.hexdigest()


def inspect_feed(feed: dict[str, DataFrame]) -> DataFrame:
    """One row of counts that describe a feed."""
    stops = feed["stops"].agg(
        F.count(F.lit(1)).alias("stops"),
        F.count_if(F.col("location_type") == "1").alias("parents"),
        F.count_if(blank_to_null(F.col("parent_station")).isNotNull()).alias("children"),
        F.slice(F.array_sort(F.collect_set(F.trim(squeezed(F.col("stop_name"))))), 1, 10).alias("sample_names"),
    )
    trips = feed["trips"].agg(F.count(F.lit(1)).alias("trips"), F.count_if(blank_to_null(F.col("shape_id")).isNull()).alias("trips_without_shape"))
    times = feed["stop_times"].agg(F.count(F.lit(1)).alias("stop_times"), F.count_if(gtfs_seconds(F.col("departure_time")) >= 86400).alias("departures_after_midnight"))
    count = lambda name: feed[name].agg(F.count(F.lit(1)).alias(name))
    out = stops
    for other in (count("routes"), trips, times, count("calendar_dates"), count("shapes")):  # one row each
        out = out.crossJoin(other)
    return out


def archive_counts(archive: str) -> dict[str, int]:
    """Rows of each text member of a ZIP, header not counted."""
    out = {}
    with zipfile.ZipFile(archive) as z:
        for info in z.infolist():
            if info.filename.endswith(".txt"):
                with z.open(info) as f:
                    out[os.path.basename(info.filename)] = max(sum(1 for _ in f) - 1, 0)
    return out


def feed_span(feed: dict[str, DataFrame]) -> DataFrame:
    """First and last service day as text, over calendar and exceptions."""
    days = feed["calendar"].select(F.col("start_date").alias("a"), F.col("end_date").alias("b")).unionByName(feed["calendar_dates"].select(F.col("date").alias("a"), F.col("date").alias("b")))
    return days.agg(F.min(blank_to_null(F.col("a"))).alias("start_date"), F.max(blank_to_null(F.col("b"))).alias("end_date"))


def feed_info(feed: dict[str, DataFrame]) -> DataFrame:
    """One row: the first row of feed_info, all null without one, with first and last day of the weekly calendar as text."""
    names = feed["feed_info"].columns
    first = feed["feed_info"].limit(1).agg(*(F.first(c).alias(c) for c in names))
    days = feed["calendar"].agg(F.min(blank_to_null(F.col("start_date"))).alias("valid_from"), F.max(blank_to_null(F.col("end_date"))).alias("valid_until"))
    return first.crossJoin(days)  # one row each

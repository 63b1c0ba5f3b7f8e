"""Schedule times, dates and labels as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gtfs_seconds(value: Column, strict: bool = False, loose: bool = False) -> Column:
    """``H:MM:SS`` to seconds; hours may pass 24. Blank or malformed gives null.

    strict also wants minutes and seconds below 60; loose takes any three
    whole numbers between colons, with blanks around them.
    """
    parts = F.split(F.trim(value), ":")
    number = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("int")
    seconds = number(0) * 3600 + number(1) * 60 + number(2)
    pattern = r"^\d+:[0-5]\d:[0-5]\d$" if strict else r"^\s*\d+\s*:\s*\d+\s*:\s*\d+\s*$" if loose else r"^\d+:\d+:\d+$"
    return F.when(F.trim(value).rlike(pattern), seconds)


def gtfs_date(value: Column) -> Column:
    """``YYYYMMDD`` to a date; anything else gives null."""
    return F.when(F.trim(value).rlike(r"^\d{8}$"), F.try_to_timestamp(F.trim(value), F.lit("yyyyMMdd")).cast("date"))


def to_gtfs_date(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def weekday_flag(day: Column, flags: list[Column]) -> Column:
    """The flag of a date's weekday out of seven, Monday first."""
    return F.element_at(F.array(*flags), F.weekday(day) + 1)


def days_between(start: Column, end: Column) -> Column:
    """All dates of an inclusive range; none if it is reversed."""
    return F.when(start <= end, F.sequence(start, end, F.expr("interval 1 day"))).otherwise(F.array().cast("array<date>"))


def sample_seconds(start: int, end: int, interval: int) -> Column:
    """Departure seconds from start up to, not including, end."""
    if interval <= 0 or end <= start:
        raise ValueError("a sample window needs a positive interval and an end after its start")
    return F.sequence(F.lit(start), F.lit(end - 1), F.lit(interval))


def clock_label(seconds: Column) -> Column:
    """``HH:MM`` of the day."""
    minutes = F.pmod(F.floor(seconds / 60), F.lit(1440))
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def clock_minutes(label: Column, last_hour: int = 29) -> Column:
    """``H:MM`` to minutes, hours up to 29; anything else gives null."""
    parts = F.split(F.trim(label), ":")
    hour, minute = parts[0].try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    return F.when(F.trim(label).rlike(r"^\d{1,2}:[0-5]\d$") & (hour <= last_hour), hour * 60 + minute)


def departure_span(times: Column) -> Column:
    """Earliest and latest minute of a list of clock labels; null fields for an empty list."""
    minutes = F.filter(F.transform(times, lambda t: clock_minutes(t)), lambda m: m.isNotNull())
    return F.struct(F.array_min(minutes).alias("earliest"), F.array_max(minutes).alias("latest"))


def shift_clock(label: Column, minutes: Column) -> Column:
    """A clock label moved by minutes, around midnight."""
    own = F.split(label, ":")
    return clock_label((own[0].cast("int") * 60 + own[1].cast("int") + minutes) * 60)


def half_up(value: Column) -> Column:
    """Rounded to the nearest whole number, halves towards plus infinity."""
    return F.floor(value + 0.5)


def minutes_label(seconds: Column) -> Column:
    return F.when(seconds.isNotNull(), F.concat(half_up(seconds / 60).cast("string"), F.lit(" min")))


def duration_label(seconds: Column) -> Column:
    """``1 h 05 min``, or minutes alone below an hour."""
    minutes = half_up(seconds / 60)
    hours = F.floor(minutes / 60)
    return F.when(seconds.isNull(), None).when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.format_string("%d h %02d min", hours.cast("int"), (minutes % 60).cast("int")))


def kilometres_label(meters: Column) -> Column:
    return F.when(meters.isNotNull(), F.concat(F.format_number(meters / 1000, 1), F.lit(" km")))


def delay_label(seconds: Column) -> Column:
    """Signed minutes; null without a delay value."""
    minutes = half_up(seconds / 60).cast("int")
    return F.when(seconds.isNull(), None).when(minutes == 0, F.lit("on time")).otherwise(F.format_string("%+d min", minutes))


def seconds_between(start: Column, end: Column, clamp: bool = False) -> Column:
    """Seconds between two ISO timestamps; null if one is invalid; negative gives null, or 0 with clamp."""
    at = lambda c: F.unix_millis(F.try_to_timestamp(c))
    diff = half_up((at(end) - at(start)) / 1000)
    return F.when(diff.isNotNull(), F.greatest(diff, F.lit(0))) if clamp else F.when(diff >= 0, diff)


def local_to_utc(local: Column, zone: str = "Europe/Berlin") -> Column:
    """A zone-less ISO time of a zone as UTC timestamp, by the zone's rules of that day."""
    return F.to_utc_timestamp(F.try_to_timestamp(local), zone)

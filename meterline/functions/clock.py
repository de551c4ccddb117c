"""UTC stamps, the reader's own clock, and billing hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(ts: Column, zone: str | float = 0) -> Column:
    """UTC instant -> the reader's wall clock.

    A number is a fixed offset in hours; a zone name follows that zone's own
    daylight-saving changes at each instant.
    """
    if isinstance(zone, str):
        return F.from_utc_timestamp(ts, zone)
    seconds = int(round(float(zone) * 3600))
    if seconds == 0:
        return ts
    return ts + F.make_dt_interval(secs=F.lit(seconds))


def local_day(ts: Column, zone: str | float = 0) -> Column:
    return F.to_date(local_time(ts, zone))


_OFFSET = r"(Z|[+-]\d{2}:?\d{2})?$"


def iso_instant(raw: Column) -> Column:
    """ISO-8601 stamp -> timestamp; bare stamps are UTC and bad ones null.

    Full stamps are cast as they are. Stamps written to the hour or the minute
    are completed first, because the cast wants seconds.
    """
    whole = F.try_to_timestamp(F.when(F.length(raw) >= 19, raw))
    minute = F.regexp_replace(raw, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})" + _OFFSET, "$1:00$2")
    hour = F.regexp_replace(minute, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})" + _OFFSET, "$1:00:00$2")
    dated = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), hour)
    return F.coalesce(whole, F.try_to_timestamp(dated))


def billing_hour(ts: Column, raw: Column) -> Column:
    """UTC hour of a usable stamp; null when the raw stamp is under 13 characters."""
    return F.when(F.length(raw) >= 13, F.hour(ts))


def billing_weekday(ts: Column, raw: Column) -> Column:
    """ISO weekday (1 = Monday) of a usable stamp."""
    return F.when(F.length(raw) >= 13, F.weekday(ts) + 1)


def epoch_to_iso(value: Column, unit: str | None) -> Column:
    """Epoch millis or seconds -> ISO-8601 UTC with milliseconds; else unchanged."""
    if unit not in ("millis", "seconds"):
        return value
    number = value.try_cast("double")
    millis = F.floor(number if unit == "millis" else number * 1000.0).cast("long")
    stamp = F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.coalesce(stamp, value)

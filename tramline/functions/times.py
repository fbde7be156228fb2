"""Timestamps in texts, and quiet windows in local time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.functions.signatures import local_hour, quiet

FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "EEE, d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd")


def parse(text: Column) -> Column:
    """A timestamp of an ISO or mail date, null if it is neither."""
    # the week day's name is only checked by strict parsers; it adds nothing
    plain = F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, ", "")
    zoned = F.regexp_replace(plain, "(?:GMT|UT)$", "+0000")
    return F.coalesce(*[F.try_to_timestamp(zoned, F.lit(f)) for f in FORMATS if not f.startswith("E")])


def quiet_end(at: Column, start: Column, end: Column, zone: Column) -> Column:
    """When a delivery may go out: `at` itself outside the quiet window, else the window's end in local time."""
    local = F.from_utc_timestamp(at, zone)
    day = F.date_trunc("day", local)
    tomorrow = (start > end) & (F.hour(local) >= start)
    local_end = day + F.make_dt_interval(F.when(tomorrow, 1).otherwise(0), end.cast("int"))
    inside = quiet(local_hour(at, zone), start, end)
    return F.when(inside, F.to_utc_timestamp(local_end, zone)).otherwise(at)

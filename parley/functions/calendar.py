"""Calendar buckets computed from epoch milliseconds.

Buckets are wall-clock ``timestamp_ntz`` values in a named time zone (the
session zone by default), built with date arithmetic that does not depend on
the session zone, so results are the same on every cluster.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grain names, coarsest first, as used for the series keys.
GRAINS = ("year", "qtr", "month", "week", "day", "hour")


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_ms_to_local(ms: Column, time_zone: str | None = "UTC") -> Column:
    """Epoch milliseconds -> wall-clock ``timestamp_ntz`` in ``time_zone``."""
    utc = F.timestamp_add("MILLISECOND", ms, _epoch())
    if time_zone in (None, "UTC", "Z", "+00:00", "GMT", "Etc/UTC"):
        return utc
    return F.convert_timezone(F.lit("UTC"), F.lit(time_zone), utc)


def ntz_to_epoch_ms(ts: Column) -> Column:
    """Wall-clock UTC ``timestamp_ntz`` -> epoch milliseconds, floored."""
    micros = F.timestamp_diff("MICROSECOND", _epoch(), ts)
    # an exact multiple of 1000 below 2**53 divides exactly in double arithmetic
    return ((micros - F.pmod(micros, F.lit(1000))) / F.lit(1000)).cast("bigint")


def bucket_start(grain: str, local: Column) -> Column:
    """Start of the ``grain`` bucket holding the wall-clock time ``local``.

    Weeks start on Monday (ISO), quarters in January, April, July, October.
    """
    day = local.cast("date")
    if grain == "hour":
        return F.timestamp_add("HOUR", F.hour(local), day.cast("timestamp_ntz"))
    if grain == "day":
        return day.cast("timestamp_ntz")
    if grain == "week":
        # dayofweek: Sunday=1 .. Saturday=7; days since Monday = (dow + 5) % 7
        return F.date_sub(day, (F.dayofweek(day) + F.lit(5)) % F.lit(7)).cast("timestamp_ntz")
    if grain == "month":
        return F.trunc(day, "month").cast("timestamp_ntz")
    if grain == "qtr":
        return F.trunc(day, "quarter").cast("timestamp_ntz")
    if grain == "year":
        return F.trunc(day, "year").cast("timestamp_ntz")
    raise ValueError(f"unknown grain {grain!r}; expected one of {GRAINS}")

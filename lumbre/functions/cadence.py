"""Schedule ticks as time buckets.

A run at tick T covers ``[previous tick, T)``; a bucket is labelled with the tick it starts at.  Every bucket
start is an expression over the row's own time, so no calendar has to be joined in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days from the epoch (a Thursday) to the first day of that name.
DAYS_FROM_EPOCH = {"monday": 4, "sunday": 3}
# Units of even width, in seconds.
WIDTHS = {"minutes": 60, "day": 24 * 3600, "week": 7 * 24 * 3600}


@dataclass(frozen=True)
class Cadence:
    """``unit`` is minutes, day, week, month, year or weekdays; ``hour`` shifts the tick within it."""

    unit: str
    hour: int = 0
    every: int = 1
    day: str = "monday"


# The schedules in use, as cron would write them.
SCHEDULES = {
    "15m": Cadence("minutes", every=15),  # */15 * * * *
    "30m": Cadence("minutes", every=30),  # */30 * * * *
    "1h": Cadence("minutes", every=60),  # 0 * * * *
    "2h": Cadence("minutes", every=120),  # 0 */2 * * *
    "6h": Cadence("minutes", every=360),  # 0 */6 * * *
    "daily": Cadence("day", hour=2),  # 0 2 * * *
    "daily_6am": Cadence("day", hour=6),  # 0 6 * * *
    "weekly": Cadence("week", hour=3, day="monday"),  # 0 3 * * 1
    "sunday": Cadence("week", day="sunday"),  # 0 0 * * 0
    "monthly": Cadence("month", hour=4),  # 0 4 1 * *
    "monthly_noon": Cadence("month", hour=12),  # 0 12 1 * *
    "yearly": Cadence("year"),  # 0 0 1 1 *
    "weekdays": Cadence("weekdays", hour=9),  # 0 9 * * 1-5
}


def _even(local: Column, width: int, offset: int) -> Column:
    """Start of the interval of ``width`` seconds, counted from ``offset`` seconds after the epoch; null for null."""
    day = F.to_date(local)
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.floor(F.second(local))
    into = F.pmod(F.unix_date(day).cast("long") * 86_400 + second - offset, F.lit(width))
    return day.cast("timestamp_ntz") + F.make_dt_interval(secs=(second - into).cast("decimal(18,6)"))


def bucket_start(ts: Column, cadence: Cadence, tz: str = "UTC") -> Column:
    """Start of the bucket that holds ``ts``, as local time (timestamp without zone) in ``tz``.

    ``ts`` without zone is taken as UTC.  Ticks are at wall-clock hours of ``tz``.  A null time has a null bucket.
    """
    shown = ts.cast("timestamp_ntz")  # of a time with zone, this is the session's wall clock
    zoned = F.convert_timezone(F.current_timezone(), F.lit("UTC"), shown)
    local = F.when(F.typeof(ts) == "timestamp", zoned).otherwise(shown)
    if tz != "UTC":
        local = F.convert_timezone(F.lit("UTC"), F.lit(tz), local)
    shift = F.make_dt_interval(hours=F.lit(cadence.hour))
    if cadence.unit in WIDTHS:
        day = DAYS_FROM_EPOCH[cadence.day] * 24 if cadence.unit == "week" else 0
        return _even(local, cadence.every * WIDTHS[cadence.unit], (day + cadence.hour) * 3600)
    if cadence.unit in ("month", "year"):
        return F.trunc(F.to_date(local - shift), cadence.unit).cast("timestamp_ntz") + shift
    if cadence.unit == "weekdays":
        day = F.to_date(local - shift)
        since_monday = F.weekday(day)  # Saturday is 5, Sunday 6: both belong to Friday's tick
        tick_day = F.date_sub(day, F.greatest(since_monday - 4, F.lit(0)))
        return tick_day.cast("timestamp_ntz") + shift
    raise ValueError(f"unknown cadence unit {cadence.unit!r}")

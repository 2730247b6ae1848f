"""Schedules of five fields: minute, hour, day of the month, month, day of the week.

A field is a list of values, ranges and steps (``*/15``, ``1-5``, ``8-18/2,22``); months and days of the week may be named, 7 is Sunday
as 0 is.  If both day fields are restricted, a day counts that meets either of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields, their least and greatest values, and names of values.
FIELDS = {"minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (0, 7)}
NAMES = {
    "month": dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), range(1, 13), strict=True)),
    "weekday": dict(zip("sun mon tue wed thu fri sat".split(), range(7), strict=True)),
}
PART = re.compile(r"(\*|(\w+)(?:-(\w+))?)(?:/([0-9]+))?")


def values_of(field: str, text: str) -> frozenset[int]:
    """The values that a field allows."""
    least, greatest = FIELDS[field]

    def number(name: str) -> int:
        value = NAMES.get(field, {}).get(name.lower(), name)
        if not str(value).isdigit() or not least <= int(value) <= greatest:
            raise ValueError(f"{name!r} is no {field}")
        return int(value)

    found: set[int] = set()
    for part in text.split(","):
        match = PART.fullmatch(part)
        if not match or match[4] == "0":
            raise ValueError(f"{part!r} is no {field}")
        whole, first, last, step = match.groups()
        if whole == "*":
            low, high = least, greatest
        else:
            low = number(first)
            high = number(last) if last else greatest if step else low
        if low > high:
            raise ValueError(f"{part!r} is no range of {field}s")
        found.update(range(low, high + 1, int(step or 1)))
    return frozenset(v % 7 for v in found) if field == "weekday" else frozenset(found)


@dataclass(frozen=True)
class Cron:
    """A parsed schedule."""

    minutes: frozenset[int]
    hours: frozenset[int]
    days: frozenset[int]
    months: frozenset[int]
    weekdays: frozenset[int]
    either_day: bool

    @property
    def slots(self) -> list[int]:
        """Minutes of the day at which the schedule ticks, on days on which it does."""
        return sorted(60 * h + m for h in self.hours for m in self.minutes)

    def on(self, day: Column) -> Column:
        """Whether the schedule ticks on a date."""
        in_month, in_week = F.dayofmonth(day).isin(*self.days), (F.dayofweek(day) - 1).isin(*self.weekdays)
        return F.month(day).isin(*self.months) & ((in_month | in_week) if self.either_day else (in_month & in_week))


def parse(text: str) -> Cron:
    parts = text.split()
    if len(parts) != len(FIELDS):
        raise ValueError(f"{text!r} has not five fields")
    values = [values_of(field, part) for field, part in zip(FIELDS, parts, strict=True)]
    return Cron(*values, either_day=not parts[2].startswith("*") and not parts[4].startswith("*"))

"""Schedules of five fields: parsing, ticks, and buckets against those given as expressions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lumbre.functions.cadence import SCHEDULES, bucket_start
from lumbre.functions.cron import parse
from lumbre.operators.cadence import tick_intervals, totals_per_tick, with_bucket

WRITTEN = {
    "15m": "*/15 * * * *",
    "30m": "*/30 * * * *",
    "1h": "0 * * * *",
    "2h": "0 */2 * * *",
    "6h": "0 */6 * * *",
    "daily": "0 2 * * *",
    "daily_6am": "0 6 * * *",
    "weekly": "0 3 * * 1",
    "sunday": "0 0 * * 7",
    "monthly": "0 4 1 * *",
    "monthly_noon": "0 12 1 * *",
    "yearly": "0 0 1 jan *",
    "weekdays": "0 9 * * MON-FRI",
}


def test_fields():
    cron = parse("*/20,7 8-18/5 1-3,31 feb,DEC 5-7")
    assert cron.minutes == {0, 7, 20, 40} and cron.hours == {8, 13, 18} and cron.days == {1, 2, 3, 31}
    assert cron.months == {2, 12} and cron.weekdays == {0, 5, 6} and cron.either_day
    assert parse("10/25 0 * * *").minutes == {10, 35} and not parse("0 0 1 * *").either_day


@pytest.mark.parametrize("text", ["", "* * * *", "60 * * * *", "* 24 * * *", "* * 0 * *", "5-1 * * * *", "*/0 * * * *", "* * * foo *", "a * * * *", "1,,2 * * * *", "* * * * 8"])
def test_what_is_no_schedule(text):
    with pytest.raises(ValueError):
        parse(text)


def matches(cron, at):
    in_month, in_week = at.day in cron.days, at.isoweekday() % 7 in cron.weekdays
    day = (in_month or in_week) if cron.either_day else (in_month and in_week)
    return day and at.month in cron.months and at.hour in cron.hours and at.minute in cron.minutes


@pytest.mark.parametrize("text", ["5,35 8-18/2 1-10,25 * mon-wed", "*/17 3,22 * * *", "0 0 29 2 *", "59 23 31 * *"])
def test_buckets_by_walking_back_minute_by_minute(spark, text):
    cron, rng = parse(text), random.Random(3)
    starts = [dt.datetime(2024, 2, 27), dt.datetime(2024, 12, 30)]
    times = [rng.choice(starts) + dt.timedelta(seconds=rng.randrange(5 * 86_400), microseconds=rng.randrange(10**6)) for _ in range(60)]
    times += [dt.datetime(2024, 3, 1, 8, 5), dt.datetime(2024, 2, 29), dt.datetime(2024, 12, 31, 23, 59), dt.datetime(2024, 12, 31, 23, 58, 59, 999999)]
    found = with_bucket(spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz"), "ts", text).collect()
    assert len(found) == len(times)
    for row in found:
        tick = row["ts"].replace(second=0, microsecond=0)
        while not matches(cron, tick):
            tick -= dt.timedelta(minutes=1)
        assert row["bucket_start"] == tick


def test_same_buckets_as_the_expressions(spark):
    rng = random.Random(4)
    times = [(dt.datetime(2023, 11, 1) + dt.timedelta(seconds=rng.randrange(200 * 86_400)),) for _ in range(400)] + [(None,)]
    rows = spark.createDataFrame(times, "ts timestamp_ntz").coalesce(2)
    for name, text in WRITTEN.items():
        both = with_bucket(rows, "ts", text).withColumn("want", bucket_start(F.col("ts"), SCHEDULES[name]))
        assert both.count() == len(times) and both.filter("not (bucket_start <=> want)").isEmpty(), name


def test_a_schedule_that_never_ticks_and_tables_without_times(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0), (None, 2.0)], "ts timestamp_ntz, value double")
    assert [r["bucket_start"] for r in with_bucket(rows, "ts", "0 0 30 2 *").collect()] == [None, None]
    assert with_bucket(rows.limit(0), "ts", "* * * * *").collect() == []
    assert [r["bucket_start"] for r in with_bucket(rows.filter("value = 2"), "ts", "* * * * *").collect()] == [None]


def test_no_pairs_of_all_rows_and_ticks(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, i), 1.0) for i in range(60)], "ts timestamp_ntz, value double")
    plan = totals_per_tick(rows, "ts", "*/2 * * * *", F.col("value"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    day = dt.date(2024, 1, 1)
    ticks = tick_intervals(spark, parse("*/2 * * * *"), day, day).orderBy("tick").collect()
    assert all(a["next_tick"] == b["tick"] for a, b in zip(ticks, ticks[1:], strict=False))

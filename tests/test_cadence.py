"""Bucket starts against ticks worked out one by one, at edges and in other time zones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumbre.functions.cadence import SCHEDULES, Cadence, bucket_start
from lumbre.operators.cadence import totals_per_bucket

MINUTE = dt.timedelta(minutes=1)


def is_tick(moment: dt.datetime, cadence: Cadence) -> bool:
    if cadence.unit == "minutes":
        return (moment.hour * 60 + moment.minute) % cadence.every == 0
    if (moment.hour, moment.minute) != (cadence.hour, 0):
        return False
    return {
        "day": True,
        "week": moment.weekday() == {"monday": 0, "sunday": 6}[cadence.day],
        "month": moment.day == 1,
        "year": moment.day == 1 and moment.month == 1,
        "weekdays": moment.weekday() < 5,
    }[cadence.unit]


def last_tick(moment: dt.datetime, cadence: Cadence) -> dt.datetime:
    tick = moment.replace(second=0, microsecond=0)
    if cadence.unit != "minutes" and not is_tick(tick, cadence):
        tick = tick.replace(minute=0)
    step = MINUTE if cadence.unit == "minutes" else dt.timedelta(hours=1)
    while not is_tick(tick, cadence):
        tick -= step
    return tick


MOMENTS = [
    dt.datetime(2024, 1, 1, 2, 59, 59, 999999),
    dt.datetime(2024, 1, 1, 3, 0),
    dt.datetime(2024, 2, 29, 23, 59, 59),
    dt.datetime(2024, 3, 1, 3, 59, 59),
    dt.datetime(2024, 3, 1, 4, 0),
    dt.datetime(2024, 3, 2, 8, 0),
    dt.datetime(2024, 3, 3, 9, 0),
    dt.datetime(2024, 3, 4, 8, 59, 59),
    dt.datetime(2024, 3, 4, 9, 0),
    dt.datetime(2023, 12, 31, 0, 0),
    dt.datetime(2024, 1, 1, 0, 0),
    dt.datetime(1969, 12, 31, 5, 7, 9),
]


@pytest.mark.parametrize("schedule", SCHEDULES)
def test_last_tick(spark, schedule):
    cadence = SCHEDULES[schedule]
    df = spark.createDataFrame([(m,) for m in MOMENTS], "ts timestamp_ntz")
    found = {r.ts: r.start for r in df.select("ts", bucket_start(F.col("ts"), cadence).alias("start")).collect()}
    assert found == {m: last_tick(m, cadence) for m in MOMENTS}


def test_time_zone(spark):
    """02:00 in Madrid is 01:00 UTC in winter and 00:00 UTC in summer."""
    moments = [dt.datetime(2024, 1, 10, 0, 59), dt.datetime(2024, 1, 10, 1, 0), dt.datetime(2024, 7, 10, 0, 0)]
    df = spark.createDataFrame([(m,) for m in moments], "ts timestamp_ntz")
    start = bucket_start(F.col("ts"), SCHEDULES["daily"], "Europe/Madrid")
    assert [r.s for r in df.select("ts", start.alias("s")).orderBy("ts").collect()] == [
        dt.datetime(2024, 1, 9, 2),
        dt.datetime(2024, 1, 10, 2),
        dt.datetime(2024, 7, 10, 2),
    ]


@pytest.mark.parametrize("schedule", SCHEDULES)
def test_every_event_is_in_one_bucket(spark, sf_dir, schedule):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    totals = totals_per_bucket(events, F.col("ts"), SCHEDULES[schedule], F.col("value"))
    assert totals.agg(F.sum("n")).first()[0] == events.count()


@pytest.mark.parametrize("name", sorted(SCHEDULES))
def test_no_row_is_lost(spark, name):
    """The buckets of every schedule add up to all rows, also to those without a time."""
    rows = [(i, MOMENTS[i % len(MOMENTS)]) for i in range(20)] + [(20, None), (21, None)]
    df = spark.createDataFrame(rows, "i int, ts timestamp_ntz")
    found = {r.bucket_start: r.n for r in totals_per_bucket(df, F.col("ts"), SCHEDULES[name], F.col("i")).collect()}
    assert sum(found.values()) == 22 and found[None] == 2


def test_times_with_zone_are_not_moved_by_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.sql("SELECT timestamp_micros(1704078000000000) AS zoned, TIMESTAMP_NTZ'2024-01-01 03:00:00' AS plain")
        starts = row.select(*(bucket_start(F.col(c), SCHEDULES["weekly"]).cast("string") for c in ("zoned", "plain"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert tuple(starts) == ("2024-01-01 03:00:00",) * 2

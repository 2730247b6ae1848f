"""Rows aggregated by the schedule bucket they fall in, for schedules given as expressions or by five fields."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumbre.functions.cadence import Cadence, bucket_start
from lumbre.functions.cron import Cron, parse

#: Days within which every schedule that ever ticks has ticked: two leap years may lie eight years apart.
LOOK_BACK = 8 * 366
#: Minutes of a bin at least, so that a bin meets at most so many intervals.
LEAST_BIN = 15


def totals_per_bucket(
    df: DataFrame, ts: Column, cadence: Cadence, amount: Column, group: Sequence[str] = (), tz: str = "UTC"
) -> DataFrame:
    """``bucket_start, group..., n, total``: what the run over each bucket would see."""
    return (
        df.select(bucket_start(ts, cadence, tz).alias("bucket_start"), *group, amount.alias("amount"))
        .groupBy("bucket_start", *group)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    )


def tick_intervals(spark: SparkSession, cron: Cron, first: dt.date, last: dt.date) -> DataFrame:
    """``tick, next_tick`` of all intervals between ticks that touch the days from ``first`` to ``last``.

    Days are put in order, not ticks: the next tick is the next slot of the same day or the first one of the next day that counts.
    """
    count = (last - first).days + 2 * LOOK_BACK + 1
    start = F.lit(first - dt.timedelta(days=LOOK_BACK))
    days = spark.range(count).select(F.date_add(start, F.col("id").cast("int")).alias("day")).filter(cron.on(F.col("day")))
    # One row per day of the calendar: a few thousand for any span of dates.
    following = F.coalesce(F.lead("day").over(W.orderBy("day")), F.date_add("day", LOOK_BACK)).alias("next_day")
    slots = cron.slots
    pairs = F.array(*(F.struct(F.lit(a).alias("at"), F.lit(b).cast("int").alias("then")) for a, b in zip(slots, [*slots[1:], None], strict=True)))

    def instant(day: str, minutes: Column) -> Column:
        return F.col(day).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes)

    each = days.select("day", following).filter((F.col("next_day") >= F.lit(first)) & (F.col("day") <= F.lit(last)))
    each = each.select("day", "next_day", F.explode(pairs).alias("slot"))
    next_tick = F.when(F.col("slot.then").isNotNull(), instant("day", F.col("slot.then"))).otherwise(instant("next_day", F.lit(slots[0])))
    return each.select(instant("day", F.col("slot.at")).alias("tick"), next_tick.alias("next_tick"))


def with_bucket(df: DataFrame, ts: str, schedule: str, into: str = "bucket_start") -> DataFrame:
    """``df`` with the tick of a five-field ``schedule`` that starts the bucket of each row; null where ``ts`` is null or nothing has ticked for eight years.

    An interval join by bins: intervals are listed in every bin they touch, rows are in one, and within a bin the bounds decide.  Bins are as
    wide as the least gap between ticks, ``LEAST_BIN`` minutes at least, so rows meet a handful of intervals and intervals few bins.
    Times without zone are taken as they are.
    """
    cron = parse(schedule)
    span = df.agg(F.min(F.to_date(ts)).alias("first"), F.max(F.to_date(ts)).alias("last")).first()
    if span["first"] is None:
        return df.withColumn(into, F.lit(None).cast("timestamp_ntz"))
    slots = cron.slots
    gap = min((b - a for a, b in zip(slots, slots[1:], strict=False)), default=24 * 60)
    width = 60_000_000 * max(gap, LEAST_BIN)

    def bin_of(instant: Column, before: int = 0) -> Column:
        return F.floor((F.unix_micros(instant.cast("timestamp")) - before) / width)

    intervals = tick_intervals(df.sparkSession, cron, span["first"], span["last"]).select(
        F.col("tick").alias("_tick"), F.col("next_tick").alias("_next")
    )
    # Bins of rows lie between the first and the last day: an interval that reaches far beyond is listed for these alone.
    low, high = (F.lit(day).cast("timestamp_ntz") for day in (span["first"], span["last"] + dt.timedelta(days=1)))
    bins = F.sequence(F.greatest(bin_of(F.col("_tick")), bin_of(low)), F.least(bin_of(F.col("_next"), 1), bin_of(high)))
    touching = (F.col("_next") > low) & (F.col("_tick") < high)
    listed = intervals.filter(touching).select(F.explode(bins).alias("_bin"), "_tick", "_next")
    at = F.col(ts).cast("timestamp_ntz")
    placed = df.withColumn("_own_bin", bin_of(at))
    inside = (F.col("_own_bin") == F.col("_bin")) & (at >= F.col("_tick")) & (at < F.col("_next"))
    return placed.join(listed, inside, "left").select(*df.columns, F.col("_tick").alias(into))


def totals_per_tick(df: DataFrame, ts: str, schedule: str, amount: Column, group: Sequence[str] = ()) -> DataFrame:
    """``bucket_start, group..., n, total`` by a schedule of five fields."""
    rows = with_bucket(df.select(F.col(ts).alias("_ts"), *group, amount.alias("amount")), "_ts", schedule)
    return rows.groupBy("bucket_start", *group).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))

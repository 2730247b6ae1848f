"""Events per schedule bucket, one query per schedule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.functions.cadence import SCHEDULES
from lumbre.operators.cadence import totals_per_bucket, totals_per_tick
from lumbre.plans.programs import table

TIME = "yyyy-MM-dd HH:mm:ss"


def shown(totals: DataFrame) -> DataFrame:
    return totals.select(
        F.date_format("bucket_start", TIME).alias("bucket_start"), "event_type", "n", F.round("total", 4).alias("total")
    )


def cadence_query(schedule: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = table(spark, sf_dir, "events")
        return shown(
            totals_per_bucket(events, F.col("ts"), SCHEDULES[schedule], F.col("value"), ["event_type"])
        )

    return query


#: A list, a range with steps, days of the month or of the week.
LISTED = "5,35 8-18/2 1-10,25 * mon-wed"


def cadence_cron(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(totals_per_tick(table(spark, sf_dir, "events"), "ts", LISTED, F.col("value"), ["event_type"]))


QUERIES = {f"cadence_{schedule}": cadence_query(schedule) for schedule in SCHEDULES} | {"cadence_cron": cadence_cron}


# ---- the same in SQL ----------------------------------------------------------------------------------------


def bucket_sql(bucket: str, source: str = "events") -> str:
    return f"""SELECT strftime({bucket}, '%Y-%m-%d %H:%M:%S') AS bucket_start, event_type, count(*) AS n,
        round(sum(value), 4) AS total FROM {source} GROUP BY 1, 2"""


def _calendar_sql(tick_test: str, hour: int) -> str:
    """Each event belongs to the last tick before it, found among all ticks of the time spanned."""
    return f"""WITH hours AS (SELECT unnest(generate_series(date_trunc('day', min(ts)) - INTERVAL 400 DAY,
            max(ts) + INTERVAL 1 DAY, INTERVAL 1 DAY)) + INTERVAL {hour} HOUR AS tick FROM events),
        ticks AS (SELECT tick FROM hours WHERE {tick_test}),
        placed AS (SELECT event_type, value, tick FROM events ASOF JOIN ticks ON ts >= tick)
        """ + bucket_sql("tick", "placed")


SQL = {
    "cadence_15m": bucket_sql("time_bucket(INTERVAL 15 MINUTE, ts)"),
    "cadence_30m": bucket_sql("time_bucket(INTERVAL 30 MINUTE, ts)"),
    "cadence_1h": bucket_sql("time_bucket(INTERVAL 1 HOUR, ts)"),
    "cadence_2h": bucket_sql("time_bucket(INTERVAL 2 HOUR, ts)"),
    "cadence_6h": bucket_sql("time_bucket(INTERVAL 6 HOUR, ts)"),
    "cadence_daily": bucket_sql("time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01 02:00:00')"),
    "cadence_daily_6am": bucket_sql("time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01 06:00:00')"),
    "cadence_weekly": bucket_sql("time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2024-01-01 03:00:00')"),
    "cadence_sunday": bucket_sql("time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2023-12-31 00:00:00')"),
    "cadence_monthly": _calendar_sql("day(tick) = 1", 4),
    "cadence_monthly_noon": _calendar_sql("day(tick) = 1", 12),
    "cadence_yearly": _calendar_sql("day(tick) = 1 AND month(tick) = 1", 0),
    "cadence_weekdays": _calendar_sql("isodow(tick) <= 5", 9),
    "cadence_cron": """WITH minutes AS (SELECT unnest(generate_series(date_trunc('day', min(ts)) - INTERVAL 60 DAY, max(ts), INTERVAL 1 MINUTE)) AS tick
          FROM events),
        ticks AS (SELECT tick FROM minutes WHERE minute(tick) IN (5, 35) AND hour(tick) IN (8, 10, 12, 14, 16, 18)
          AND (day(tick) <= 10 OR day(tick) = 25 OR isodow(tick) IN (1, 2, 3))),
        placed AS (SELECT event_type, value, tick FROM events ASOF JOIN ticks ON ts >= tick)
        """
    + bucket_sql("tick", "placed"),
}

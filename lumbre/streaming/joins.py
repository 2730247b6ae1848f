"""Two streams joined within an interval of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.operators.runlog import COMPLETED, FAILED_STATES, MAX_WAIT_SECONDS

RUN = ("app_name", "run_no")


def submissions_with_endings(submitted: DataFrame, ended: DataFrame, delay: str = "1 hour", max_wait: int = MAX_WAIT_SECONDS) -> DataFrame:
    """``app_name, run_no, started_at, ended_at, state, seq`` of submissions and the endings within ``max_wait`` seconds of them.

    ``submitted``: ``app_name, run_no, started_at``, ``ended``: ``app_name, run_no, ended_at, state, seq``, both streams that may be late by
    ``delay``.  A submission comes out with every ending it meets, and once without one when none can come any more: that is when both
    streams have passed its deadline by the delay.  Either side is kept no longer than that, so the state holds the runs of one
    waiting time, whatever the stream has seen.
    """
    left = submitted.select(*RUN, F.col("started_at").cast("timestamp").alias("started_at")).withWatermark("started_at", delay)
    right = ended.select(
        *(F.col(c).alias(f"_{c}") for c in RUN), F.col("ended_at").cast("timestamp").alias("ended_at"), "state", "seq"
    ).withWatermark("ended_at", delay)
    within = (F.col("ended_at") >= F.col("started_at")) & (F.col("ended_at") < F.col("started_at") + F.expr(f"interval {max_wait} seconds"))
    same = (F.col("app_name") == F.col("_app_name")) & (F.col("run_no") == F.col("_run_no"))
    return left.join(right, same & within, "left_outer").select(*RUN, "started_at", "ended_at", "state", "seq")


def first_endings(met: DataFrame) -> DataFrame:
    """``app_name, run_no, status, state, start_time, end_time, duration_seconds``: the first ending of each run, ``timeout`` without one."""
    first = F.min(F.when(F.col("ended_at").isNotNull(), F.struct("ended_at", "seq", "state"))).alias("first")
    runs = met.groupBy(*RUN, "started_at").agg(first)
    took = F.unix_micros("first.ended_at") - F.unix_micros("started_at")
    status = F.when(F.col("first.state") == COMPLETED, "success").when(F.col("first.state").isin(*FAILED_STATES), "failed").otherwise("timeout")
    return runs.select(
        *RUN,
        status.alias("status"),
        F.col("first.state").alias("state"),
        F.col("started_at").cast("timestamp_ntz").alias("start_time"),
        F.col("first.ended_at").cast("timestamp_ntz").alias("end_time"),
        (took / 1_000_000).alias("duration_seconds"),
    )

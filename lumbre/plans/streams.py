"""Streaming queries over the test tables; each is checked against the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.operators import words
from lumbre.operators.runlog import COMPLETED, FAILED_STATES
from lumbre.plans import cadences, programs, runlog
from lumbre.storage import new_folder
from lumbre.streaming.joins import first_endings, submissions_with_endings
from lumbre.streaming.runs import watched_outcomes
from lumbre.streaming.tables import (
    append_available,
    arrivals,
    read_appended,
    read_latest,
    stream_session,
    stream_table,
    update_available,
)

LATE_BY = "1 hour"
LATE_BY_MICROS = 3600 * 1_000_000


#: Times at which the input of a registered stream arrives; each is a micro-batch at least.
ARRIVALS = 3


def replayed(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream of its own session."""
    return stream_table(stream_session(spark), path)


def word_count_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "word-count")
    for source in arrivals(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", ARRIVALS, f"{path}/documents"):
        update_available(words.word_count(words.text_lines(replayed(spark, source), "text")), path, ["word"])
    return read_latest(spark, path, ["word"])


def cadence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour buckets kept up to date as events arrive, with late ones up to an hour."""
    path = new_folder(spark, "cadence")
    keys = ["bucket_start", "event_type"]
    for source in arrivals(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", ARRIVALS, f"{path}/events"):
        totals = (
            replayed(spark, source)
            .select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
            .withWatermark("ts", LATE_BY)
            .groupBy(F.window("ts", "6 hours"), "event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
            .select(F.col("window.start").alias("bucket_start"), "event_type", "n", "total")
        )
        update_available(totals, path, keys)
    return cadences.shown(read_latest(spark, path, keys))


def run_outcomes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes that were certain when the stream had seen all polls."""
    path = new_folder(spark, "outcomes")
    for source in arrivals(runlog.event_polls(spark, sf_dir), "ts", ARRIVALS, f"{path}/polls"):
        polls = replayed(spark, source)
        append_available(watched_outcomes(polls, LATE_BY, runlog.MAX_UNKNOWN, runlog.MAX_WAIT_SECONDS, "event_id"), path)
    return read_appended(spark, path).select(
        "app_name", "run_no", "status", "state", runlog.time_text("start_time"), runlog.time_text("end_time")
    )


def run_spans_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions joined with their endings as two streams: how long each run took that is over for certain."""
    path = new_folder(spark, "spans")
    for source in arrivals(runlog.event_polls(spark, sf_dir), "ts", ARRIVALS, f"{path}/polls"):
        polls = replayed(spark, source)
        submitted = polls.filter("state = 'SUBMITTED'").select("app_name", "run_no", F.col("ts").alias("started_at"))
        ended = polls.filter(F.col("state").isin(COMPLETED, *FAILED_STATES))
        ended = ended.select("app_name", "run_no", F.col("ts").alias("ended_at"), "state", F.col("event_id").alias("seq"))
        append_available(submissions_with_endings(submitted, ended, LATE_BY, runlog.MAX_WAIT_SECONDS), path)
    spans = first_endings(read_appended(spark, path))
    return spans.withColumns({c: runlog.time_text(c) for c in ("start_time", "end_time")})


QUERIES = {
    "word_count_stream": word_count_stream,
    "cadence_stream": cadence_stream,
    "run_outcomes_stream": run_outcomes_stream,
    "run_spans_stream": run_spans_stream,
}

_WAIT = runlog.MAX_WAIT_SECONDS * 1_000_000
_WATERMARK = f"((SELECT max(us) FROM polls) // 1000 * 1000 - {LATE_BY_MICROS})"

SQL = {
    "word_count_stream": programs.WORD_COUNT,
    "cadence_stream": cadences.SQL["cadence_6h"],
    "run_outcomes_stream": f"""WITH {runlog.outcome_ctes(_WATERMARK)}
        SELECT app_name, run_no, status, state, {runlog.sql_time("started")} AS start_time, {runlog.sql_time("ended")} AS end_time
        FROM outcomes WHERE status IN ('success', 'failed', 'timeout') AND (ended + 999) // 1000 * 1000 < {_WATERMARK}""",
    "run_spans_stream": f"""WITH {runlog.POLLS},
        ends AS (SELECT app_name, run_no, us, event_id, state FROM polls WHERE state IN ('COMPLETED', 'FAILED')),
        submitted AS (SELECT app_name, run_no, us AS started FROM polls WHERE state = 'SUBMITTED'),
        passed AS (SELECT least((SELECT max(started) FROM submitted), (SELECT max(us) FROM ends)) // 1000 * 1000 - {LATE_BY_MICROS} AS us),
        spans AS (
          SELECT s.app_name, s.run_no, s.started, min(e.us) AS ended, arg_min(e.state, (e.us, e.event_id)) AS state
          FROM submitted s LEFT JOIN ends e
            ON s.app_name = e.app_name AND s.run_no = e.run_no AND e.us >= s.started AND e.us < s.started + {_WAIT}
          GROUP BY ALL)
        SELECT app_name, run_no, CASE state WHEN 'COMPLETED' THEN 'success' WHEN 'FAILED' THEN 'failed' ELSE 'timeout' END AS status, state,
               {runlog.sql_time("started")} AS start_time, {runlog.sql_time("ended")} AS end_time,
               CAST(ended - started AS DOUBLE) / 1000000 AS duration_seconds
        FROM spans WHERE ended IS NOT NULL OR started + {_WAIT} <= (SELECT us FROM passed)""",
}

"""Run-log queries; polls and output lines are derived from the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.functions.text import WHITE, run_key
from lumbre.operators import runlog
from lumbre.operators.ordered import in_segments, running_totals
from lumbre.plans.programs import document_lines, table
from lumbre.sources.sinks import append_run_records
from lumbre.storage import new_folder

# Limits at which every outcome occurs in the test data.
MAX_UNKNOWN = 2
MAX_WAIT_SECONDS = 3 * 24 * 3600

# States as they are polled, and the phrases in the lines below.
STATES = {"signup": "SUBMITTED", "view": "RUNNING", "click": "UNKNOWN", "purchase": "COMPLETED", "error": "FAILED"}
# Lines without content, of every kind of white space.
BLANKS = ("   ", "\t", "\r", "\xa0")
TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def time_text(column: str) -> Column:
    return F.date_format(column, TIME).alias(column)


def job_name(user: Column) -> Column:
    return F.concat(F.lit("Daily Job_"), user.cast("string"))


def event_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``app_name, run_no, started_at, ts, state``: each user is a job, each signup submits a run of it.

    Which run a poll belongs to is a running count per user; one user may have most of the events, so it is counted
    in segments.
    """
    state = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))[F.col("event_type")]
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", state.alias("state"))
    submitted = F.col("state") == "SUBMITTED"
    order = [F.asc("ts"), F.asc("event_id")]
    numbered = running_totals(
        in_segments(events, order, ["user_id"]),
        order,
        {
            "run_no": ("sum", F.when(submitted, 1).otherwise(0)),
            "started_at": ("max", F.when(submitted, F.col("ts"))),
        },
        ["user_id"],
    )
    return numbered.filter("run_no > 0").select(
        F.col("user_id").cast("string").alias("app_name"), "run_no", "started_at", "ts", "state", "event_id"
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, line_no, line``: what the jobs would have printed, one line per event."""
    when = F.date_format("ts", "yy/MM/dd HH:mm:ss")
    cents = F.floor(F.col("value") * 100).cast("string")
    kind = F.col("event_type")
    line = (
        F.when(kind == "signup", F.concat(when, F.lit(" INFO SparkContext: Running job "), F.col("user_id")))
        .when(kind == "view", F.concat(F.lit("📊 Progreso: "), cents))
        .when(kind == "click", F.element_at(F.array(*map(F.lit, BLANKS)), (F.col("event_id") % 4 + 1).cast("int")))
        .when(kind == "purchase", F.concat(F.lit("Pi is roughly 3."), cents, F.when(F.col("event_id") % 2 == 0, "\r").otherwise("")))
        .otherwise(F.concat(when, F.lit(" ERROR Executor: 📋 code "), cents))
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("line_no"), line.alias("line")
    )


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run printed as its result; only lines with a result are told which run they belong to."""
    printed = event_lines(spark, sf_dir).filter(F.col("line").contains(runlog.RESULT_PHRASE)).drop("run_id")
    of_run = event_polls(spark, sf_dir).select("app_name", "run_no", F.col("event_id").alias("line_no"))
    return runlog.extract_result(of_run.join(printed, "line_no"), ["app_name", "run_no"])


def log_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.relevant_lines(event_lines(spark, sf_dir))


def log_key_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.key_lines(event_lines(spark, sf_dir))


def log_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.extract_result(event_lines(spark, sf_dir))


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last 20 lines of every document."""
    return runlog.tail(document_lines(spark, sf_dir), ["doc_id"])


def log_tail_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail shown for a failure: 30 of the last 50 lines."""
    sizes = (runlog.SERVER_TAIL_LINES, runlog.SHOWN_TAIL_LINES)
    return runlog.tail(event_lines(spark, sf_dir), sizes=sizes)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = event_polls(spark, sf_dir)
    return runlog.run_outcomes(polls, max_unknown=MAX_UNKNOWN, max_wait=MAX_WAIT_SECONDS, order="event_id")


def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).select(
        "app_name",
        "run_no",
        "status",
        "state",
        time_text("start_time"),
        time_text("end_time"),
        "duration_seconds",
        "elapsed_seconds",
        "polls",
        "unknown_polls",
    )


def run_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = runlog.job_durations(outcomes(spark, sf_dir))
    return jobs.withColumns({c: time_text(c) for c in ("first_start", "last_end")})


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the finished runs, written to a run log and read back."""
    path = new_folder(spark, "run-log")
    records = runlog.run_records(
        outcomes(spark, sf_dir),
        job_name(F.col("app_name")),
        run_key(job_name(F.col("app_name")), F.col("start_time")),
        {"max_unknown": str(MAX_UNKNOWN), "max_wait": str(MAX_WAIT_SECONDS)},
        run_results(spark, sf_dir),
    )
    append_run_records(records, path)
    return spark.read.parquet(path).select(
        "job_name",
        "app_name",
        "status",
        "state",
        "exit_code",
        "duration_seconds",
        time_text("start_time"),
        time_text("end_time"),
        "elapsed_seconds",
        "pi_value",
        F.col("parameters")["max_wait"].alias("max_wait"),
    )


def run_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key under which each submission would run."""
    submitted = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    return submitted.select("event_id", run_key(job_name(F.col("user_id")), F.col("ts")).alias("run_key"))


QUERIES = {
    "log_relevant": log_relevant,
    "log_key_lines": log_key_lines,
    "log_extract": log_extract,
    "log_tail": log_tail,
    "log_tail_failed": log_tail_failed,
    "run_outcomes": run_outcomes,
    "run_durations": run_durations,
    "run_records": run_records,
    "run_keys": run_keys,
}


# ---- the same in SQL ----------------------------------------------------------------------------------------

_DATE = "strftime(ts, '%y/%m/%d %H:%M:%S')"
WHITE_TEXT = "'" + "".join(chr(c) for a, b in WHITE for c in range(a, b + 1)) + "'"
_CENTS = "CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR)"
LINES = f"""
lines AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS line_no,
         CASE event_type WHEN 'signup' THEN {_DATE} || ' INFO SparkContext: Running job ' || user_id
                         WHEN 'view' THEN '📊 Progreso: ' || {_CENTS}
                         WHEN 'click' THEN [{', '.join(f"'{b}'" for b in BLANKS)}][event_id % 4 + 1]
                         WHEN 'purchase' THEN 'Pi is roughly 3.' || {_CENTS} || CASE WHEN event_id % 2 = 0 THEN chr(13) ELSE '' END
                         ELSE {_DATE} || ' ERROR Executor: 📋 code ' || {_CENTS} END AS line
  FROM events
)"""


def _contains(phrases) -> str:
    return "(" + " OR ".join(f"contains(line, '{p}')" for p in phrases) + ")"


def _tail_sql(lines: str, run: str, size: int) -> str:
    return f"""WITH {lines}, numbered AS (
          SELECT *, row_number() OVER (PARTITION BY {run} ORDER BY line_no DESC) AS from_end FROM lines)
        SELECT {run}, line_no, line FROM numbered WHERE from_end <= {size} AND trim(line, {WHITE_TEXT}) <> ''"""


DOCUMENT_LINES = """
split AS (SELECT doc_id, string_split(text, chr(10)) AS all_lines FROM documents),
lines AS (SELECT doc_id, CAST(unnest(range(len(all_lines))) AS INTEGER) AS line_no, unnest(all_lines) AS line FROM split)"""

POLLS = """
numbered AS (
  SELECT CAST(user_id AS VARCHAR) AS app_name, ts, event_id, epoch_us(ts) AS us,
         CASE event_type WHEN 'signup' THEN 'SUBMITTED' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'UNKNOWN'
                         WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS state,
         CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
              OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_no
  FROM events
),
polls AS (SELECT * FROM numbered WHERE run_no > 0)"""


def outcome_ctes(now: str = "NULL") -> str:
    """Walk through the polls of each run in order; the first that ends the watch decides."""
    wait = MAX_WAIT_SECONDS * 1_000_000
    return f"""{POLLS},
walk AS (
  SELECT *, first_value(us) OVER w AS started,
         sum(CASE WHEN state = 'UNKNOWN' THEN 1 ELSE 0 END) OVER w AS unknowns,
         row_number() OVER (PARTITION BY app_name, run_no ORDER BY us DESC, event_id DESC) AS from_end
  FROM polls WINDOW w AS (PARTITION BY app_name, run_no ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)
),
judged AS (
  SELECT *, CASE WHEN us - started >= {wait} THEN 'timeout' WHEN state = 'COMPLETED' THEN 'success'
                 WHEN state = 'FAILED' THEN 'failed'
                 WHEN state = 'UNKNOWN' AND unknowns > {MAX_UNKNOWN} THEN 'failed' END AS verdict
  FROM walk
),
ends AS (
  SELECT app_name, run_no, min(started) AS started, max(us) AS last, count(*) AS polls,
         count(*) FILTER (WHERE state = 'UNKNOWN') AS unknown_polls,
         max(state) FILTER (WHERE from_end = 1) AS last_state,
         arg_min(verdict, (us, event_id)) FILTER (WHERE verdict IS NOT NULL) AS verdict,
         arg_min(state, (us, event_id)) FILTER (WHERE verdict IS NOT NULL) AS verdict_state,
         min(us) FILTER (WHERE verdict IS NOT NULL) AS verdict_at
  FROM judged GROUP BY app_name, run_no
),
closed AS (
  SELECT *, verdict = 'timeout' OR (verdict IS NULL AND {now} >= started + {wait}) AS late FROM ends
),
outcomes AS (
  SELECT app_name, run_no,
         CASE WHEN late THEN 'timeout' WHEN verdict IS NOT NULL THEN verdict
              WHEN last_state IN ('SUBMITTED', 'RUNNING') THEN 'running' ELSE 'waiting' END AS status,
         CASE WHEN late THEN NULL ELSE verdict_state END AS state, started,
         CASE WHEN late THEN started + {wait} WHEN verdict IS NOT NULL THEN verdict_at ELSE last END AS ended,
         polls, unknown_polls
  FROM closed
)"""


def sql_time(expression: str) -> str:
    return f"strftime(make_timestamp({expression}), '%Y-%m-%d %H:%M:%S.%f')"


_SPAN = f"""{sql_time("started")} AS start_time, {sql_time("ended")} AS end_time,
       CAST(ended - started AS DOUBLE) / 1000000 AS duration_seconds,
       CAST((ended - started) // 1000000 AS INTEGER) AS elapsed_seconds"""

OUTCOME_COLUMNS = f"app_name, run_no, status, state, {_SPAN}, polls, unknown_polls"

SQL = {
    "log_relevant": f"""WITH {LINES} SELECT * FROM lines WHERE trim(line, {WHITE_TEXT}) <> ''
        AND NOT regexp_matches(line, '^[0-9][0-9]/[0-9][0-9]/[0-9][0-9] ') AND {_contains(runlog.RELEVANT_MARKERS)}""",
    "log_key_lines": f"WITH {LINES} SELECT * FROM lines WHERE {_contains(runlog.KEY_PHRASES)}",
    "log_extract": f"""WITH {LINES}, hits AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS turn
          FROM lines WHERE contains(line, 'Pi is roughly'))
        SELECT run_id, hits.line_no, trim(string_split(line, 'roughly')[2], {WHITE_TEXT}) AS result_text,
               TRY_CAST(trim(string_split(line, 'roughly')[2], {WHITE_TEXT}) AS DOUBLE) AS result
        FROM (SELECT DISTINCT run_id FROM lines) LEFT JOIN (SELECT * FROM hits WHERE turn = 1) hits USING (run_id)""",
    "log_tail": _tail_sql(DOCUMENT_LINES, "doc_id", 20),
    "log_tail_failed": _tail_sql(LINES, "run_id", 30),
    "run_outcomes": f"WITH {outcome_ctes()} SELECT {OUTCOME_COLUMNS} FROM outcomes",
    "run_durations": f"""WITH {outcome_ctes()}, took AS (
          SELECT *, CASE WHEN status IN ('success', 'failed', 'timeout') THEN ended - started END AS us FROM outcomes)
        SELECT app_name, count(*) AS runs, count(us) AS finished,
               CAST(count(*) FILTER (WHERE status = 'success') AS DOUBLE) / nullif(count(us), 0) AS success_rate,
               CAST(sum(us) AS DOUBLE) / nullif(count(us), 0) / 1000000 AS avg_seconds,
               CAST(quantile_disc(us, 0.5) AS DOUBLE) / 1000000 AS p50_seconds,
               CAST(quantile_disc(us, 0.95) AS DOUBLE) / 1000000 AS p95_seconds,
               {sql_time("min(started)")} AS first_start, {sql_time("max(ended)")} AS last_end
        FROM took GROUP BY app_name""",
    "run_records": f"""WITH {outcome_ctes()}, {LINES},
        printed AS (SELECT app_name, run_no, arg_min(line, line_no) AS line FROM polls JOIN lines ON line_no = event_id
          WHERE contains(line, 'Pi is roughly') GROUP BY ALL)
        SELECT 'Daily Job_' || app_name AS job_name, 'daily-job-' || app_name || '-' || started // 1000000 AS app_name,
               status, state, CAST(CASE status WHEN 'success' THEN 0 ELSE 1 END AS INTEGER) AS exit_code, {_SPAN},
               TRY_CAST(trim(string_split(line, 'roughly')[2], {WHITE_TEXT}) AS DOUBLE) AS pi_value, '{MAX_WAIT_SECONDS}' AS max_wait
        FROM outcomes LEFT JOIN printed USING (app_name, run_no) WHERE status IN ('success', 'failed', 'timeout')""",
    "run_keys": """SELECT event_id, replace(replace(lower('Daily Job_' || user_id), ' ', '-'), '_', '-') || '-'
               || epoch_us(ts) // 1000000 AS run_key FROM events WHERE event_type = 'signup'""",
}

"""Run-log analytics: status polls to outcomes, output lines to the lines and values that matter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumbre.functions.text import first_value_after, is_blank
from lumbre.operators.ordered import percentiles
from lumbre.storage import cut_lineage

# States a job controller reports and what they mean.
COMPLETED = "COMPLETED"
FAILED_STATES = ("FAILED", "SUBMISSION_FAILED", "INVALIDATING")
RUNNING_STATES = ("SUBMITTED", "RUNNING", "PENDING_RERUN", "SUCCEEDING")
UNKNOWN = "UNKNOWN"
PENDING = ""
MAX_UNKNOWN = 10
MAX_WAIT_SECONDS = 300

# Markers of relevant output, key phrases of a driver log, and the phrase before a result.
RELEVANT_MARKERS = ("🚀", "📊", "📋", "🔍", "📈", "✅", "🔢", "•")
KEY_PHRASES = ("Pi is roughly", "ERROR", "INFO SparkContext")
RESULT_PHRASE = "Pi is roughly"
RESULT_WORD = "roughly"
LOG_DATE = r"^\d{2}/\d{2}/\d{2} "

TAIL_LINES = 20
SERVER_TAIL_LINES = 50
SHOWN_TAIL_LINES = 30


def _any_of(line: Column, phrases: Sequence[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | line.contains(phrase)
    return found


def relevant_lines(
    lines: DataFrame, markers: Sequence[str] = RELEVANT_MARKERS, prefixes: Sequence[str] | None = None
) -> DataFrame:
    """Lines that are not blank, are no Spark log lines (they start with a date) and contain a marker.

    ``prefixes`` replaces the general date test by fixed starts such as ``24/`` and ``25/``.
    """
    line = F.col("line")
    if prefixes is None:
        dated = line.rlike(LOG_DATE)
    else:
        dated = F.lit(False)
        for prefix in prefixes:
            dated = dated | line.startswith(prefix)
    return lines.filter(~is_blank(line) & ~dated & _any_of(line, markers))


def key_lines(lines: DataFrame, phrases: Sequence[str] = KEY_PHRASES) -> DataFrame:
    """Lines that contain any of the phrases."""
    return lines.filter(_any_of(F.col("line"), phrases))


def extract_result(
    lines: DataFrame, run: Sequence[str] = ("run_id",), phrase: str = RESULT_PHRASE, word: str = RESULT_WORD
) -> DataFrame:
    """Per run: the text after ``word`` in its first line with ``phrase``; null when no line has it.

    ``run..., line_no, result_text, result``; only lines with the phrase are grouped, the runs come from the keys.
    """
    hits = lines.filter(F.col("line").contains(phrase)).groupBy(*run).agg(
        F.min(F.struct("line_no", "line")).alias("first")
    )
    text = first_value_after(F.col("first.line"), word)
    values = hits.select(
        *run,
        F.col("first.line_no").alias("line_no"),
        text.alias("result_text"),
        text.try_cast("double").alias("result"),
    )
    return lines.select(*run).distinct().join(values, list(run), "left")


def tail(
    lines: DataFrame, run: Sequence[str] = ("run_id",), sizes: Sequence[int] = (TAIL_LINES,)
) -> DataFrame:
    """The last lines of every run without the blank ones; several sizes are tails of tails.

    Blank lines go after the cut.  The row-number limit is applied within each task before the shuffle, so a run
    with very many lines sends only its last few from every task.
    """
    last = W.partitionBy(*run).orderBy(F.desc("line_no"))
    return (
        lines.withColumn("_from_end", F.row_number().over(last))
        .filter(F.col("_from_end") <= min(sizes))
        .drop("_from_end")
        .filter(~is_blank(F.col("line")))
    )


def run_outcomes(
    polls: DataFrame,
    run: Sequence[str] = ("app_name", "run_no"),
    max_unknown: int = MAX_UNKNOWN,
    max_wait: int = MAX_WAIT_SECONDS,
    now: Column | None = None,
    order: str | None = None,
) -> DataFrame:
    """What became of each run, from its polled states ``run..., ts, state``.

    Polls at the same instant count in the order of the column ``order``.

    A run is watched from its first poll.  COMPLETED is success; a failed state, or more than ``max_unknown``
    UNKNOWN polls in total, is failure; whatever comes first counts.  ``max_wait`` seconds after the start the watch
    ends as a timeout, as soon as a later poll or ``now`` shows that time has passed.  Otherwise the run is pending
    (no state yet), running or, in any other state, waiting.

    Everything is an aggregate over instants: each task reduces its polls of a run to one row of numbers before the
    shuffle, and only the first ``max_unknown + 1`` UNKNOWN polls per task are looked at in order.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    turn = F.struct(micros.alias("at"), (F.col(order) if order else F.lit(0)).cast("long").alias("seq"))
    timed = polls.select(*run, turn.alias("turn"), F.coalesce("state", F.lit(PENDING)).alias("state"))

    def first_in(state: str) -> Column:
        return F.min(F.when(F.col("state") == state, F.col("turn"))).alias(f"first_{state}")

    seen = timed.groupBy(*run).agg(
        F.count(F.lit(1)).alias("polls"),
        F.count(F.when(F.col("state") == UNKNOWN, 1)).alias("unknown_polls"),
        F.min("turn.at").alias("started"),
        F.max(F.struct("turn", "state")).alias("latest"),
        *(first_in(state) for state in (COMPLETED, *FAILED_STATES)),
    ).withColumn("last", F.col("latest.turn.at"))
    in_turn = W.partitionBy(*run).orderBy("turn")
    too_many = (
        timed.filter(F.col("state") == UNKNOWN)
        .select(*run, "turn", F.row_number().over(in_turn).alias("number"))
        .filter(F.col("number") == max_unknown + 1)
        .select(*run, F.col("turn").alias("too_many_unknown"))
    )
    deadline = F.col("started") + max_wait * 1_000_000
    passed = F.col("last") >= deadline
    if now is not None:
        passed = passed | (F.unix_micros(now.cast("timestamp")) >= deadline)

    def candidate(at: Column, seq: Column, rank: int, status: str, state: str | None) -> Column:
        names = {"at": at, "seq": seq, "rank": F.lit(rank), "status": F.lit(status), "state": F.lit(state)}
        return F.struct(*(value.alias(name) for name, value in names.items()))

    def ending(column: str, rank: int, status: str, state: str) -> Column:
        at, seq = F.col(column)["at"], F.col(column)["seq"]
        return F.when(at < deadline, candidate(at, seq, rank, status, state))

    decided = F.least(
        ending(f"first_{COMPLETED}", 0, "success", COMPLETED),
        *(ending(f"first_{s}", i, "failed", s) for i, s in enumerate(FAILED_STATES, start=1)),
        ending("too_many_unknown", 8, "failed", UNKNOWN),
        F.when(passed, candidate(deadline, F.lit(0).cast("long"), 9, "timeout", None)),
    )
    open_status = (
        F.when(F.col("latest.state").isin(*RUNNING_STATES), "running")
        .when(F.col("latest.state") == PENDING, "pending")
        .otherwise("waiting")
    )
    ended = F.coalesce(F.col("decided.at"), F.col("last"))

    def time(at: Column) -> Column:
        return F.timestamp_micros(at).cast("timestamp_ntz")

    return (
        seen.join(too_many, list(run), "left")
        .withColumn("decided", decided)
        .select(
            *run,
            F.coalesce("decided.status", open_status).alias("status"),
            F.col("decided.state").alias("state"),
            time(F.col("started")).alias("start_time"),
            time(ended).alias("end_time"),
            ((ended - F.col("started")) / 1_000_000).alias("duration_seconds"),
            F.expr("(coalesce(decided.at, last) - started) div 1000000").cast("int").alias("elapsed_seconds"),
            "polls",
            "unknown_polls",
        )
    )


TERMINAL = ("success", "failed", "timeout")


def job_durations(outcomes: DataFrame, job: Sequence[str] = ("app_name",)) -> DataFrame:
    """Per job: runs, finished runs, success rate of the finished ones, and their durations in seconds."""
    finished = F.col("status").isin(*TERMINAL)
    took = F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))
    runs = cut_lineage(  # read for the totals and for the percentiles
        outcomes.select(*job, "status", "start_time", "end_time", F.when(finished, took).alias("took"))
    )
    ended = F.count("took")
    totals = runs.groupBy(*job).agg(
        F.count(F.lit(1)).alias("runs"),
        ended.alias("finished"),
        (F.count(F.when(F.col("status") == "success", 1)) / F.nullif(ended, F.lit(0))).alias("success_rate"),
        # whole microseconds are summed, so the average does not depend on the order of the rows
        (F.sum("took") / F.nullif(ended, F.lit(0)) / 1_000_000).alias("avg_seconds"),
        F.min("start_time").alias("first_start"),
        F.max("end_time").alias("last_end"),
    )
    ranked = percentiles(runs, "took", {"p50": 0.5, "p95": 0.95}, job)
    seconds = [(F.col(p) / 1_000_000).alias(f"{p}_seconds") for p in ("p50", "p95")]
    return totals.join(ranked.select(*job, *seconds), list(job), "left")


def run_records(
    outcomes: DataFrame,
    job_name: Column,
    app_name: Column,
    parameters: dict[str, str],
    results: DataFrame | None = None,
    run: Sequence[str] = ("app_name", "run_no"),
) -> DataFrame:
    """Run records of finished runs: 0 is the exit code of a success, 1 of anything else.

    ``results`` (``run..., result``, as ``extract_result`` gives it) fills ``pi_value``; a run without a result has none.
    """
    if results is not None:
        outcomes = outcomes.join(results.select(*run, F.col("result").alias("pi_value")), list(run), "left")
    pairs = [F.lit(text) for item in sorted(parameters.items()) for text in item]
    return outcomes.filter(F.col("status").isin(*TERMINAL)).select(
        job_name.alias("job_name"),
        app_name.alias("app_name"),
        "status",
        "state",
        F.when(F.col("status") == "success", 0).otherwise(1).alias("exit_code"),
        "duration_seconds",
        "start_time",
        "end_time",
        "elapsed_seconds",
        *(["pi_value"] if results is not None else []),
        F.create_map(*pairs).alias("parameters"),
    )

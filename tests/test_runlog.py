"""Outcome rules, log-line filters and tails on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lumbre.operators import runlog
from lumbre.sources.sinks import RUN_RECORD, append_run_records

START = dt.datetime(2024, 1, 1)


def polls(spark, *states, run="r", step=10):
    data = [(run, 1, START + dt.timedelta(seconds=step * i), s) for i, s in enumerate(states)]
    return spark.createDataFrame(data, "app_name string, run_no int, ts timestamp_ntz, state string")


def outcome(spark, *states, **options):
    step = options.pop("step", 10)
    row = runlog.run_outcomes(polls(spark, *states, step=step), **options).first()
    return row.status, row.state, row.elapsed_seconds


@pytest.mark.parametrize(
    ("states", "expected"),
    [
        (["", "SUBMITTED", "RUNNING", "COMPLETED"], ("success", "COMPLETED", 30)),
        (["SUBMITTED", "RUNNING", "FAILED", "COMPLETED"], ("failed", "FAILED", 20)),
        (["SUBMITTED", "SUBMISSION_FAILED"], ("failed", "SUBMISSION_FAILED", 10)),
        (["RUNNING", "INVALIDATING"], ("failed", "INVALIDATING", 10)),
        (["SUBMITTED", "RUNNING", "PENDING_RERUN"], ("running", None, 20)),
        (["RUNNING", "SUCCEEDING"], ("running", None, 10)),
        (["", None], ("pending", None, 10)),
        (["RUNNING", "STRANGE"], ("waiting", None, 10)),
        (["RUNNING"] * 40, ("timeout", None, 300)),
        (["RUNNING"] * 30 + ["COMPLETED"], ("timeout", None, 300)),
        (["RUNNING"] * 29 + ["COMPLETED"], ("success", "COMPLETED", 290)),
        (["UNKNOWN"] * 10 + ["COMPLETED"], ("success", "COMPLETED", 100)),
        (["UNKNOWN", "RUNNING"] * 11, ("failed", "UNKNOWN", 200)),
    ],
)
def test_outcome(spark, states, expected):
    assert outcome(spark, *states) == expected


def test_unknown_at_once(spark):
    assert outcome(spark, "RUNNING", "UNKNOWN", "COMPLETED", max_unknown=0) == ("failed", "UNKNOWN", 10)


def test_clock_ends_the_watch(spark):
    later = F.lit(START + dt.timedelta(seconds=301))
    assert outcome(spark, "RUNNING", now=later) == ("timeout", None, 300)
    assert outcome(spark, "RUNNING", now=F.lit(START + dt.timedelta(seconds=299))) == ("running", None, 0)


def walk(states, max_unknown, max_wait, step):
    """The poll loop, one poll at a time."""
    unknown = 0
    for i, state in enumerate(states):
        if i * step >= max_wait:
            return "timeout", None
        if state == "COMPLETED":
            return "success", state
        if state in runlog.FAILED_STATES:
            return "failed", state
        if state == "UNKNOWN":
            unknown += 1
            if unknown > max_unknown:
                return "failed", state
    last = states[-1]
    return ("running" if last in runlog.RUNNING_STATES else "pending" if last == "" else "waiting"), None


def test_outcomes_like_the_poll_loop(spark):
    draw = random.Random(11)
    choices = ["", "RUNNING", "SUBMITTED", "UNKNOWN", "UNKNOWN", "COMPLETED", "FAILED", "OTHER"]
    runs = {f"r{i}": [draw.choice(choices) for _ in range(draw.randint(1, 9))] for i in range(200)}
    data = [(r, 1, START + dt.timedelta(seconds=10 * i), s) for r, states in runs.items() for i, s in enumerate(states)]
    draw.shuffle(data)
    df = spark.createDataFrame(data, "app_name string, run_no int, ts timestamp_ntz, state string")
    found = runlog.run_outcomes(df, max_unknown=1, max_wait=60).collect()
    assert {r.app_name: (r.status, r.state) for r in found} == {r: walk(s, 1, 60, 10) for r, s in runs.items()}


def lines(spark, *texts, run="r"):
    return spark.createDataFrame([(run, i, t) for i, t in enumerate(texts)], "run_id string, line_no int, line string")


def shown(df):
    return [r.line for r in df.orderBy("line_no").collect()]


def test_relevant_lines(spark):
    given = lines(spark, "", "  ", "📊 a", "24/01/05 10:00:00 INFO 📊", "26/01/05 x ✅", "plain", "• b", "26/x 🚀")
    assert shown(runlog.relevant_lines(given)) == ["📊 a", "• b", "26/x 🚀"]
    assert shown(runlog.relevant_lines(given, prefixes=("24/", "25/"))) == ["📊 a", "26/01/05 x ✅", "• b", "26/x 🚀"]


def test_key_lines(spark):
    given = lines(spark, "x Pi is roughly 3", "ERROR", "INFO SparkContext: y", "INFO Other", "error")
    assert shown(runlog.key_lines(given)) == ["x Pi is roughly 3", "ERROR", "INFO SparkContext: y"]


def test_extract_result(spark):
    given = lines(spark, "start", "Pi is roughly 3.14 roughly", "Pi is roughly 9").unionByName(
        lines(spark, "roughly 7", run="none")
    ).unionByName(lines(spark, "Pi is roughly pie", run="text"))
    found = {r.run_id: (r.line_no, r.result_text, r.result) for r in runlog.extract_result(given).collect()}
    assert found == {"r": (1, "3.14", 3.14), "none": (None, None, None), "text": (0, "pie", None)}


def test_tail_cuts_before_it_drops_blanks(spark):
    texts = [str(i) for i in range(60)]
    texts[45] = texts[59] = " "
    given = lines(spark, *texts)
    assert shown(runlog.tail(given)) == [str(i) for i in range(40, 60) if i not in (45, 59)]
    assert shown(runlog.tail(given, sizes=(50, 30))) == [str(i) for i in range(30, 60) if i not in (45, 59)]
    assert shown(runlog.tail(lines(spark, "a", "b"))) == ["a", "b"]


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    done = runlog.run_outcomes(polls(spark, "RUNNING", "COMPLETED"))
    records = runlog.run_records(done, F.lit("job"), F.lit("job-1"), {"num_rows": "1000"})
    append_run_records(records, path)
    append_run_records(records.select("job_name", "status").withColumn("pi_value", F.lit("3.14")), path)
    log = spark.read.parquet(path)
    assert log.schema.simpleString() == spark.createDataFrame([], RUN_RECORD).schema.simpleString()
    rows = sorted(log.collect(), key=lambda r: r.pi_value or 0)
    assert (rows[0].exit_code, rows[0].duration_seconds, rows[0].parameters) == (0, 10.0, {"num_rows": "1000"})
    assert (rows[1].job_name, rows[1].pi_value, rows[1].start_time) == ("job", 3.14, None)
    with pytest.raises(ValueError, match="typo"):
        append_run_records(records.withColumn("typo", F.lit(1)), path)


def test_every_run_has_one_outcome(spark, sf_dir):
    from lumbre.plans import runlog as plan

    outcomes = plan.outcomes(spark, sf_dir)
    assert outcomes.count() == outcomes.select("app_name", "run_no").distinct().count()
    assert outcomes.count() == spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'signup'").count()

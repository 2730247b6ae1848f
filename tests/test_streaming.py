"""Streams over several batches against the batch result; late and repeated input."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumbre.operators import runlog, words
from lumbre.sources.files import stream_lines
from lumbre.streaming.joins import first_endings, submissions_with_endings
from lumbre.streaming.outcomes import reduce_batches, stream_outcomes
from lumbre.streaming.runs import watched_outcomes
from lumbre.streaming.tables import (
    PROVIDER,
    append_available,
    read_appended,
    read_latest,
    stream_session,
    stream_table,
    update_available,
)

START = dt.datetime(2024, 1, 1)
POLL = "app_name string, run_no long, started_at timestamp_ntz, ts timestamp_ntz, state string"


def add_file(spark, path, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def test_state_is_kept_on_disk_unless_chosen(spark):
    assert "RocksDB" in stream_session(spark).conf.get(PROVIDER)
    other = spark.newSession()
    chosen = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    other.conf.set(PROVIDER, chosen)
    assert stream_session(other).conf.get(PROVIDER) == chosen


def test_word_count_goes_on_where_it_stopped(spark, tmp_path, rows):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for texts in (["a b", "b"], ["b c"], ["a  b"]):
        add_file(spark, source, [(t,) for t in texts], "line string")
        update_available(words.word_count(stream_table(stream_session(spark), source)), out)
    assert rows(read_latest(spark, out, ["word"])) == rows(words.word_count(spark.read.parquet(source)))
    assert spark.read.parquet(f"{out}/table").filter("word = 'c'").count() == 1


def test_text_files_as_a_stream(spark, tmp_path, rows):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for name, text in {"a.txt": "a b\n\n", "b.txt": " b"}.items():
        (source / name).write_text(text)
        update_available(words.word_count(stream_lines(stream_session(spark), str(source))), out)
    assert rows(read_latest(spark, out, ["word"])) == [("", 2), ("a", 1), ("b", 2)]


def timeline(seed, runs=60):
    draw = random.Random(seed)
    data = []
    for i in range(runs):
        begin = START + dt.timedelta(seconds=draw.randrange(3000), microseconds=draw.randrange(1000) * 1000 + 7)
        at = begin
        for j in range(draw.randint(1, 12)):
            state = "SUBMITTED" if j == 0 else draw.choice(["RUNNING"] * 4 + ["UNKNOWN"] * 4 + ["COMPLETED", "FAILED"])
            data.append((f"job{i % 7}", i, begin, at, state))
            at += dt.timedelta(seconds=draw.randrange(1, 120))
    data.append(("end", 999, START + dt.timedelta(hours=3), START + dt.timedelta(hours=3), "SUBMITTED"))
    return sorted(data, key=lambda r: r[3])


@pytest.mark.parametrize("batches", [1, 6])
def test_outcomes_like_batch(spark, tmp_path, batches):
    """The same outcomes, each once, however the polls are cut into batches and disordered within the delay."""
    data = timeline(batches)
    draw = random.Random(1)
    data.sort(key=lambda r: r[3] + dt.timedelta(seconds=draw.randrange(50)))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    size = -(-len(data) // batches)
    for i in range(0, len(data), size):
        add_file(spark, source, data[i : i + size], POLL)
        polls = stream_table(stream_session(spark), source)
        append_available(stream_outcomes(polls, "60 seconds", max_unknown=1, max_wait=300, buckets=5), out)
    found = {(r.app_name, r.run_no): r for r in read_appended(spark, out).collect()}
    assert len(found) == read_appended(spark, out).count()
    now = F.lit(START + dt.timedelta(hours=3) - dt.timedelta(seconds=60))
    batch = runlog.run_outcomes(
        spark.read.parquet(source), ["app_name", "run_no"], max_unknown=1, max_wait=300, now=now
    ).filter("app_name <> 'end'")
    expected = {(r.app_name, r.run_no): r for r in batch.collect()}
    assert len({r.status for r in expected.values()}) == 3
    assert {k: (r.status, r.state, r.end_time) for k, r in found.items()} == {
        k: (r.status, r.state, r.end_time) for k, r in expected.items()
    }


def test_polls_after_the_outcome_start_no_new_run(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def at(seconds, state, app="a", begin=0):
        return (app, 1, START + dt.timedelta(seconds=begin), START + dt.timedelta(seconds=seconds), state)

    for data in (
        [at(0, "SUBMITTED"), at(10, "COMPLETED")],
        [at(100, "SUBMITTED", "b", 100)],
        [at(120, "FAILED"), at(130, "RUNNING")],
        [at(1000, "SUBMITTED", "c", 1000)],
        [at(1100, "FAILED"), at(2000, "SUBMITTED", "d", 2000)],
    ):
        add_file(spark, source, data, POLL)
        append_available(stream_outcomes(stream_table(stream_session(spark), source), "1 second", max_wait=300, buckets=2), out)
    found = sorted((r.app_name, r.status) for r in read_appended(spark, out).collect())
    assert found == [("a", "success"), ("b", "timeout"), ("c", "timeout")]


@pytest.mark.parametrize("batches", [1, 5])
def test_watched_outcomes_like_batch(spark, tmp_path, batches):
    """State by run: the same outcomes, each once, however the polls are cut into batches and disordered within the delay."""
    data = timeline(batches)
    draw = random.Random(1)
    data.sort(key=lambda r: r[3] + dt.timedelta(seconds=draw.randrange(50)))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    size = -(-len(data) // batches)
    for i in range(0, len(data), size):
        add_file(spark, source, data[i : i + size], POLL)
        append_available(watched_outcomes(stream_table(stream_session(spark), source), "60 seconds", 1, 300), out)
    found = [(r.app_name, r.run_no, r.status, r.state, r.end_time) for r in read_appended(spark, out).collect()]
    now = F.lit(START + dt.timedelta(hours=3) - dt.timedelta(seconds=60))
    batch = runlog.run_outcomes(spark.read.parquet(source), max_unknown=1, max_wait=300, now=now).filter("app_name <> 'end'")
    assert sorted(found, key=repr) == sorted(((r.app_name, r.run_no, r.status, r.state, r.end_time) for r in batch.collect()), key=repr)
    assert len({f[2] for f in found}) == 3


def test_a_batch_changes_the_state_of_its_runs_alone(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def at(seconds, run, state, begin=0):
        return ("a", run, START + dt.timedelta(seconds=begin), START + dt.timedelta(seconds=seconds), state)

    def step(*data):
        add_file(spark, source, data, POLL)
        return append_available(watched_outcomes(stream_table(stream_session(spark), source), "1 second", max_wait=300), out)

    step(*(at(0, i, "SUBMITTED") for i in range(50)))
    assert sum(b.changed for b in step(at(10, 7, "RUNNING"))) == 1  # one run of fifty
    step(at(20, 7, "COMPLETED"), at(30, 8, "RUNNING"))
    batches = step(at(5, 9, "COMPLETED"), at(31, 8, "RUNNING"))  # the first poll is later than a second
    assert sum(b.late for b in batches) == 1
    step(at(1000, 99, "SUBMITTED", 1000))
    step(at(1001, 7, "FAILED"), at(1002, 99, "RUNNING", 1000))  # run 7 is over and forgotten
    found = sorted((r.run_no, r.status) for r in read_appended(spark, out).collect())
    assert found == [(i, "success" if i == 7 else "timeout") for i in range(50)]


def test_runs_of_a_group_are_read_and_written_together(spark, tmp_path):
    """However many runs a batch holds, its state is changed once per group, and each outcome still comes out at its own time."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def at(seconds, run, state, begin=0):
        return ("a", run, START + dt.timedelta(seconds=begin), START + dt.timedelta(seconds=seconds), state)

    def step(*data):
        add_file(spark, source, data, POLL)
        polls = stream_table(stream_session(spark), source)
        batches = append_available(watched_outcomes(polls, "1 second", max_wait=300, groups=3), out)
        return max(b.changed for b in batches), sorted((r.run_no, r.status) for r in read_appended(spark, out).collect())

    assert step(*(at(0, i, "SUBMITTED") for i in range(90))) == (3, [])
    changed, found = step(*(at(10 + i, i, "COMPLETED") for i in range(30)), at(25, 99, "SUBMITTED", 25))
    assert changed <= 3 and found == [(i, "success") for i in range(28)]  # up to 38 seconds less the delay
    changed, found = step(at(600, 100, "SUBMITTED", 600), *(at(50, i, "FAILED") for i in range(30, 90)))
    assert changed <= 3 and found == sorted([*((i, "success") for i in range(30)), *((i, "failed") for i in range(30, 90)), (99, "timeout")])
    assert step(at(610, 5, "FAILED"), at(611, 100, "COMPLETED", 600))[1] == found  # run 5 is over and forgotten


def test_a_run_with_very_many_polls_is_small_before_the_shuffle():
    n = 10_000
    batch = pd.DataFrame(
        {
            "app_name": "hot",
            "run_no": 1,
            "started": 0,
            "at": range(n),
            "seq": 0,
            "state": ["SUBMITTED"] + ["UNKNOWN"] * (n // 2) + ["RUNNING"] * (n - 2 - n // 2) + ["FAILED"],
        }
    )
    kept = pd.concat(reduce_batches(iter([batch.sample(frac=1, random_state=1)]), 10))
    assert sorted(kept["at"]) == [*range(12), n - 1]


def test_buckets_follow_late_events(spark, tmp_path):
    """An event late by less than the delay still changes its bucket."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([(0, 1.0), (3500, 1.0)], [(3700, 1.0)], [(3400, 5.0), (7300, 1.0)]):
        add_file(spark, source, [(START + dt.timedelta(seconds=s), v) for s, v in batch], "ts timestamp, value double")
        events = stream_table(stream_session(spark), source).withWatermark("ts", "1 hour")
        totals = events.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        update_available(totals.select(F.col("window.start").alias("start"), "n", "total"), out)
    latest = read_latest(spark, out, ["start"]).orderBy("start").collect()
    assert [(r.n, r.total) for r in latest] == [(3, 7.0), (1, 1.0), (1, 1.0)]


def test_folders_stay_few_over_many_batches(spark, tmp_path, rows, monkeypatch):
    from lumbre.streaming import tables

    monkeypatch.setattr(tables, "FOLDERS", 3)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(9):
        add_file(spark, source, [(f"w{i % 4} all",)], "line string")
        update_available(words.word_count(stream_table(stream_session(spark), source)), out, ["word"])
        assert len(tables.numbered(spark, f"{out}/table")) <= 3 and len(tables.numbered(spark, f"{out}/whole")) <= 1
        assert rows(read_latest(spark, out, ["word"])) == rows(words.word_count(spark.read.parquet(source)))


def test_a_failed_compaction_leaves_a_right_table(spark, tmp_path, rows, monkeypatch):
    """A whole table without its mark is not read; folders that it would have replaced are."""
    from lumbre.streaming import tables

    out = str(tmp_path / "out")
    for i, data in enumerate(([("a", 1), ("b", 1)], [("a", 2)], [("c", 1)])):
        spark.createDataFrame(data, "word string, n int").write.parquet(f"{out}/table/batch={i}")
    want = [("a", 2), ("b", 1), ("c", 1)]
    monkeypatch.setattr(tables, "FOLDERS", 1)
    read_latest(spark, out, ["word"]).write.parquet(f"{out}/whole/upto=2")
    assert rows(read_latest(spark, out, ["word"])) == want  # written, nothing deleted yet
    (tmp_path / "out/whole/upto=2/_SUCCESS").unlink()
    assert rows(read_latest(spark, out, ["word"])) == want
    tables.compact(spark, out, ["word"])
    assert not tables.numbered(spark, f"{out}/table") and rows(read_latest(spark, out, ["word"])) == want


def test_submissions_meet_their_endings(spark, tmp_path):
    """Endings out of order and too late, runs without one, and submissions that come after their ending."""
    out = str(tmp_path / "out")

    def at(seconds):
        return START + dt.timedelta(seconds=seconds)

    steps = [
        ([("a", 1, at(0)), ("b", 1, at(5))], [("c", 1, at(20), "FAILED", 1)]),
        ([("c", 1, at(15))], [("a", 1, at(30), "COMPLETED", 2), ("a", 1, at(25), "FAILED", 3)]),
        ([("d", 1, at(400))], [("b", 1, at(305), "COMPLETED", 4), ("x", 1, at(410), "FAILED", 5)]),
        ([("e", 1, at(1000))], [("d", 1, at(699), "COMPLETED", 6), ("x", 1, at(1010), "FAILED", 7)]),
    ]
    for submitted, ended in steps:
        add_file(spark, str(tmp_path / "s"), submitted, "app_name string, run_no long, started_at timestamp_ntz")
        add_file(spark, str(tmp_path / "e"), ended, "app_name string, run_no long, ended_at timestamp_ntz, state string, seq long")
        own = stream_session(spark)
        met = submissions_with_endings(stream_table(own, str(tmp_path / "s")), stream_table(own, str(tmp_path / "e")), "60 seconds", 300)
        append_available(met, out)
    found = {r.app_name: (r.status, r.state, r.duration_seconds) for r in first_endings(read_appended(spark, out)).collect()}
    assert found == {"a": ("failed", "FAILED", 25.0), "b": ("timeout", None, None), "c": ("failed", "FAILED", 5.0), "d": ("success", "COMPLETED", 299.0)}


def test_joined_streams_share_a_store(spark, tmp_path):
    """One store per partition of state, and batches that add their changes to it."""
    out = str(tmp_path / "out")
    for i in range(2):
        add_file(spark, str(tmp_path / "s"), [("a", i, START)], "app_name string, run_no long, started_at timestamp_ntz")
        ended = ("a", i, START + dt.timedelta(seconds=5), "COMPLETED", 1)
        add_file(spark, str(tmp_path / "e"), [ended], "app_name string, run_no long, ended_at timestamp_ntz, state string, seq long")
        own = stream_session(spark, 1)
        append_available(submissions_with_endings(stream_table(own, str(tmp_path / "s")), stream_table(own, str(tmp_path / "e"))), out)
    state = tmp_path / "out/checkpoint/state/0/0"
    assert not [p.name for p in state.iterdir() if p.is_dir() and p.name.startswith(("left", "right"))]
    assert list(state.rglob("*.changelog"))
    assert sorted(r.run_no for r in first_endings(read_appended(spark, out)).collect()) == [0, 1]

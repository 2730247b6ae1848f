"""Run outcomes from a stream of status polls.

The rules need the first few UNKNOWN polls of a run in order, which no built-in aggregate keeps, so the state is kept
in pandas.  Runs are gathered in hash buckets and each bucket is handled as one frame: a call of the state function
per run would cost more than the work in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumbre.operators.runlog import COMPLETED, FAILED_STATES, MAX_UNKNOWN, MAX_WAIT_SECONDS, UNKNOWN

# Open runs are spread over this many buckets; a stream keeps the number it was started with.
BUCKETS = 256

# Which state ends a run, in the order that counts for polls that nothing else tells apart.
ENDINGS = {COMPLETED: "success", **dict.fromkeys(FAILED_STATES, "failed")}
RANK = {**{name: i for i, name in enumerate(ENDINGS)}, UNKNOWN: 8}
TIMEOUT_RANK = 9
# Stands for the polls of a run whose outcome has been given out.
GIVEN_OUT = "given out"

RUN = ["app_name", "run_no", "started"]
KEPT = [*RUN, "at", "seq", "state"]
POLLS = "bucket int, app_name string, run_no long, started long, at long, seq long, state string, ts timestamp"
STATE = "app_name array<string>, run_no array<long>, started array<long>, at array<long>, seq array<long>, state array<string>"
OUTCOME = "app_name string, run_no long, status string, state string, started long, ended long"


def first_polls(polls: pd.DataFrame, max_unknown: int) -> pd.DataFrame:
    """The polls that can matter, in order of time.

    Per run: its first poll, the first one in each ending state, and as many UNKNOWN ones as it takes to fail.
    """
    polls = polls.sort_values(["at", "seq"], kind="stable")
    turn = polls.groupby([*RUN, "state"], sort=False).cumcount()
    deciding = polls["state"].isin([*RANK, GIVEN_OUT])
    wanted = deciding & (turn <= (polls["state"] == UNKNOWN) * max_unknown)
    return polls[wanted | ~polls.duplicated(RUN)]


def reduce_batches(batches: Iterator[pd.DataFrame], max_unknown: int) -> Iterator[pd.DataFrame]:
    """Before the shuffle: a run with very many polls shrinks to a few per batch of rows.

    The latest poll of a batch stays too, as it moves the watermark.
    """
    for batch in batches:
        kept = first_polls(batch, max_unknown)
        latest = batch.loc[[batch["at"].idxmax()]]
        yield kept if latest.index[0] in kept.index else pd.concat([kept, latest])


def _outcomes(held: pd.DataFrame, max_unknown: int, wait: int) -> pd.DataFrame:
    """``RUN, ended, rank, state, deadline``: what ends each run's watch; at the latest its deadline does."""
    deadline = held["started"] + wait
    turn = held.groupby([*RUN, "state"], sort=False).cumcount()
    ends = held["state"].isin(list(ENDINGS)) | ((held["state"] == UNKNOWN) & (turn == max_unknown))
    found = held[ends & (held["at"] < deadline)]
    found = found.assign(rank=found["state"].map(RANK).astype("int64"))
    runs = held.drop_duplicates(RUN)
    late = runs.assign(at=runs["started"] + wait, seq=0, state=None, rank=TIMEOUT_RANK)
    first = pd.concat([found, late]) if len(found) else late
    first = first.sort_values(["at", "seq", "rank"]).drop_duplicates(RUN)
    return first.rename(columns={"at": "ended"}).assign(deadline=first["started"] + wait)


def _millis(micros: pd.Series) -> pd.Series:
    """Rounded up, so that the watermark is past the instant itself."""
    return -(-micros // 1000)


def watch_bucket(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, max_unknown: int, max_wait: int
) -> Iterator[pd.DataFrame]:
    """Keep the first polls of a bucket's runs and give each outcome once no earlier poll can still arrive.

    That is when the watermark has passed the instant of the outcome.  A run stays known until its deadline has
    passed as well, so that its later polls are not taken for a new run.
    """
    wait = max_wait * 1_000_000
    watermark = state.getCurrentWatermarkMs()
    held = pd.DataFrame(dict(zip(KEPT, state.get, strict=True)) if state.exists else {c: [] for c in KEPT})
    if not state.hasTimedOut:
        known = pd.MultiIndex.from_frame(held[RUN])
        for batch in batches:
            # a run that is past its deadline and not known has been given out and forgotten
            gone = (_millis(batch["started"] + wait) <= watermark) & ~pd.MultiIndex.from_frame(batch[RUN]).isin(known)
            fresh = batch.loc[~gone, KEPT]
            if len(fresh):
                held = first_polls(pd.concat([held, fresh]) if len(held) else fresh, max_unknown)
    if not len(held):
        if state.exists:
            state.remove()
        return

    watched = _outcomes(held, max_unknown, wait)
    given = pd.MultiIndex.from_frame(held.loc[held["state"] == GIVEN_OUT, RUN])
    before = pd.MultiIndex.from_frame(watched[RUN]).isin(given)
    now = (_millis(watched["ended"]) < watermark) & ~before
    if now.any():
        out = watched[now]
        status = out["state"].map({**ENDINGS, UNKNOWN: "failed"}).fillna("timeout")
        yield out.assign(status=status)[["app_name", "run_no", "status", "state", "started", "ended"]]

    done = before | now
    over = done & (_millis(watched["deadline"]) <= watermark)
    waiting = watched[~done]
    marked = watched[done & ~over].assign(state=GIVEN_OUT)
    marked = marked.assign(at=marked["started"])[KEPT]
    still_open = pd.MultiIndex.from_frame(held[RUN]).isin(pd.MultiIndex.from_frame(waiting[RUN]))
    kept = pd.concat([held[still_open], marked])
    if not len(kept):
        state.remove()
        return
    state.update(tuple(kept[c].tolist() for c in KEPT))
    due = [*_millis(waiting["ended"]), *_millis(marked["started"] + wait)]
    state.setTimeoutTimestamp(max(int(min(due)), watermark + 1))


def stream_outcomes(
    polls: DataFrame,
    delay: str = "1 hour",
    max_unknown: int = MAX_UNKNOWN,
    max_wait: int = MAX_WAIT_SECONDS,
    buckets: int = BUCKETS,
    order: str | None = None,
) -> DataFrame:
    """``app_name, run_no, status, state, start_time, end_time`` of finished runs.

    ``polls``: ``app_name, run_no, started_at, ts, state`` as a stream, every poll carrying the start of its run;
    polls at the same instant count in the order of the column ``order``.
    Polls may be late by ``delay``; an outcome is given out once, when event time has passed it by that much.
    """
    prepared = polls.select(
        F.pmod(F.xxhash64("app_name", "run_no"), F.lit(buckets)).cast("int").alias("bucket"),
        "app_name",
        "run_no",
        F.unix_micros(F.col("started_at").cast("timestamp")).alias("started"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        (F.col(order) if order else F.lit(0)).cast("long").alias("seq"),
        F.coalesce("state", F.lit("")).alias("state"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    decided = (
        prepared.mapInPandas(partial(reduce_batches, max_unknown=max_unknown), POLLS)
        .withWatermark("ts", delay)
        .groupBy("bucket")
        .applyInPandasWithState(
            partial(watch_bucket, max_unknown=max_unknown, max_wait=max_wait),
            OUTCOME,
            STATE,
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )

    def time(column: str):
        return F.timestamp_micros(column).cast("timestamp_ntz")

    return decided.select(
        "app_name", "run_no", "status", "state", time("started").alias("start_time"), time("ended").alias("end_time")
    )

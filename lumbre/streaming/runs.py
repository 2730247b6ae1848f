"""Run outcomes from a stream of status polls, with state by group of runs.

Runs are dealt out to groups by a hash.  A group is read, judged and written in one call and has one timer, at the instant from which the next of its
outcomes can be known: with state of their own, runs cost some twenty exchanges between Spark and Python each, which took far longer than the
work on their polls.  A batch reads and writes the groups that it holds polls of and those that are due, and no others.  A group holds the few polls of
its open runs that can still matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumbre.operators.runlog import MAX_UNKNOWN, MAX_WAIT_SECONDS, UNKNOWN
from lumbre.streaming.outcomes import ENDINGS, RANK, TIMEOUT_RANK, reduce_batches

# Open runs are dealt out to this many groups; a stream keeps the number it was started with.
GROUPS = 1024

POLLS = "app_name string, run_no long, started long, at long, seq long, state string, ts timestamp"
# The timer that is set, and for every run: which it is, its start, whether its outcome has been given out, and its polls.
STATE = (
    "due long, app_name array<string>, run_no array<long>, started array<long>, given array<boolean>, "
    "at array<array<long>>, seq array<array<long>>, state array<array<string>>"
)
OUTCOME = "app_name string, run_no long, status string, state string, started long, ended long"
STATUS = {**ENDINGS, UNKNOWN: "failed"}


def first_of_run(polls: list[tuple[int, int, str]], max_unknown: int) -> list[tuple[int, int, str]]:
    """The polls that can decide: the first one in each ending state, and as many UNKNOWN ones as it takes to fail."""
    seen: dict[str, int] = {}
    kept = []
    for poll in sorted(polls):
        turn = seen.get(poll[2], 0)
        seen[poll[2]] = turn + 1
        if poll[2] in RANK and turn <= (poll[2] == UNKNOWN) * max_unknown:
            kept.append(poll)
    return kept


def outcome_of(started: int, polls: list[tuple[int, int, str]], max_unknown: int, wait: int) -> tuple[int, str | None]:
    """The instant and state that end a run, going by its deciding polls; its deadline (and no state) at the latest."""
    unknown = [p for p in polls if p[2] == UNKNOWN]
    ends = [p for p in polls if p[2] != UNKNOWN] + unknown[max_unknown : max_unknown + 1]
    candidates = [(at, seq, RANK[state], state) for at, seq, state in ends if at < started + wait]
    at, _, _, state = min([*candidates, (started + wait, 0, TIMEOUT_RANK, None)], key=lambda c: c[:3])
    return at, state


def millis(micros: int) -> int:
    """Rounded up, so that the watermark is past the instant itself."""
    return -(-micros // 1000)


class RunWatch(StatefulProcessor):
    """Gives the outcome of a run once no earlier poll can still arrive: when the watermark has passed its instant.

    A run stays known until its deadline has passed as well, so that its later polls are not taken for a new run.
    """

    def __init__(self, max_unknown: int, max_wait: int):
        self.max_unknown, self.wait = max_unknown, max_wait * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", STATE)

    def _held(self) -> tuple[int | None, dict[tuple, tuple[int, bool, list]]]:
        """The timer that is set, and ``started, given, polls`` by run."""
        held = self.group.get()
        if held is None:
            return None, {}
        due, *columns = held
        return due, {(name, number): (started, given, list(zip(*polls, strict=True))) for name, number, started, given, *polls in zip(*columns, strict=True)}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        due, runs = self._held()
        arrived = defaultdict(list)
        for r in rows:
            arrived[r.app_name, r.run_no].append((r.started, r.at, r.seq, r.state))
        changed = False
        for run, fresh in arrived.items():
            started, given, polls = runs.get(run) or (min(f[0] for f in fresh), False, [])
            if given or (run not in runs and millis(started + self.wait) <= watermark):
                continue  # given out, or forgotten as well
            runs[run] = started, False, first_of_run(polls + [f[1:] for f in fresh], self.max_unknown)
            changed = True
        yield from self._judge(runs, due, None, watermark, changed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due, runs = self._held()
        if runs:
            yield from self._judge(runs, due, expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs(), False)

    def _judge(self, runs: dict, due: int | None, expired: int | None, watermark: int, changed: bool) -> Iterator[Row]:
        """The outcomes that are certain now; what is left is kept, and the timer set for what comes next."""
        kept, following = {}, None
        for run, (started, given, polls) in runs.items():
            at, state = (started + self.wait, None) if given else outcome_of(started, polls, self.max_unknown, self.wait)
            if not given and millis(at) < watermark:
                yield Row(app_name=run[0], run_no=run[1], status=STATUS.get(state, "timeout"), state=state, started=started, ended=at)
                at, given, polls, changed = started + self.wait, True, [], True
            if given and millis(started + self.wait) <= watermark:
                changed = True
                continue
            kept[run] = started, given, polls
            instant = max(millis(at), watermark) + 1
            following = instant if following is None else min(following, instant)
        if due not in (None, expired, following):
            self.handle.deleteTimer(due)
        if following not in (None, due):
            self.handle.registerTimer(following)
        if not kept and due is not None:
            self.group.clear()
        elif kept and (changed or following != due):
            columns = ([run[0] for run in kept], [run[1] for run in kept], [r[0] for r in kept.values()], [r[1] for r in kept.values()])
            self.group.update((following, *columns, *([[p[i] for p in r[2]] for r in kept.values()] for i in range(3))))

    def close(self) -> None:
        pass


def watched_outcomes(
    polls: DataFrame,
    delay: str = "1 hour",
    max_unknown: int = MAX_UNKNOWN,
    max_wait: int = MAX_WAIT_SECONDS,
    order: str | None = None,
    groups: int = GROUPS,
) -> DataFrame:
    """``app_name, run_no, status, state, start_time, end_time`` of finished runs.

    ``polls``: ``app_name, run_no, started_at, ts, state`` as a stream, every poll carrying the start of its run; polls at the same
    instant count in the order of the column ``order``.  Polls may be late by ``delay``; an outcome is given out once, when event time
    has passed it by that much.  A run with very many polls shrinks to a few per batch of rows before the shuffle.
    """
    prepared = polls.select(
        "app_name",
        "run_no",
        F.unix_micros(F.col("started_at").cast("timestamp")).alias("started"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        (F.col(order) if order else F.lit(0)).cast("long").alias("seq"),
        F.coalesce("state", F.lit("")).alias("state"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    reduced = prepared.mapInPandas(partial(reduce_batches, max_unknown=max_unknown), POLLS).withWatermark("ts", delay)
    group = F.pmod(F.xxhash64("app_name", "run_no"), F.lit(groups)).cast("int").alias("group")
    decided = reduced.select(group, "*").groupBy("group").transformWithState(
        statefulProcessor=RunWatch(max_unknown, max_wait), outputStructType=OUTCOME, outputMode="append", timeMode="eventTime"
    )

    def time(column: str):
        return F.timestamp_micros(column).cast("timestamp_ntz")

    return decided.select("app_name", "run_no", "status", "state", time("started").alias("start_time"), time("ended").alias("end_time"))

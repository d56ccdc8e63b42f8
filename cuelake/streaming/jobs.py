"""The life of a job as state with event-time timers, on a stream and, by the same rules, on a table.

Events ask for a change: ``queue``, ``claim``, ``complete``, ``fail`` and ``interrupt``. A change that a
job's status does not allow is refused. A waiting or running job that hears nothing for ``idle_us`` fails
by itself; an ended one is deleted ``keep_us`` later and is then as if it had never been. A deadline that lies before an event takes effect
before it, whether the timer or the event comes first, so a stream and a table tell the same story.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGES = "job_id long, ts_us long, event_id long, was string, status string, reason string"
STATE = "status string, updated_us long"

# From which status each event leads where.
ALLOWED = {
    "queue": ((None,), "queued"),
    "claim": (("queued",), "processing"),
    "complete": (("processing",), "complete"),
    "fail": (("queued", "processing"), "failed"),
    "interrupt": (("processing",), "queued"),
}


@dataclass(frozen=True)
class Lifetimes:
    """idle_us: silence after which an active job fails. keep_us: how long an ended job is kept."""

    idle_us: int = 24 * 3_600_000_000
    keep_us: int = 24 * 3_600_000_000


State = tuple[str, int] | None


def deadline(state: State, p: Lifetimes) -> int | None:
    if state is None:
        return None
    return state[1] + (p.idle_us if state[0] in ("queued", "processing") else p.keep_us)


def overdue(state: State, now_us: int, p: Lifetimes) -> tuple[State, list[tuple]]:
    """What the clock alone has done to a job by ``now_us``."""
    out = []
    while (at := deadline(state, p)) is not None and at <= now_us:
        status, reason = ("failed", "idle") if state[0] in ("queued", "processing") else ("deleted", "expired")
        out.append((at, None, state[0], status, reason))
        state = (status, at) if status == "failed" else None
    return state, out


def heard(state: State, event: tuple[int, int, str], p: Lifetimes) -> tuple[State, list[tuple]]:
    """An event (ts_us, event_id, kind), with the deadlines before it."""
    ts, event_id, kind = event
    state, out = overdue(state, ts, p)
    was = state[0] if state else None
    sources, status = ALLOWED.get(kind, ((), None))
    if was not in sources:
        return state, [*out, (ts, event_id, was, was, "refused")]
    return (status, ts), [*out, (ts, event_id, was, status, kind)]


def _rows(changes: list[tuple]) -> pd.DataFrame:
    """(job_id, ts_us, event_id, was, status, reason) rows; a deadline's change has no event."""
    d = pd.DataFrame(changes, columns=["job_id", "ts_us", "event_id", "was", "status", "reason"])
    return d.astype({"job_id": "int64", "ts_us": "int64", "event_id": "Int64"})


class Jobs(StatefulProcessor):
    def __init__(self, p: Lifetimes):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", STATE)

    def _get(self) -> State:
        return tuple(self.state.get()) if self.state.exists() else None

    def _put(self, state: State) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if state is None:
            self.state.clear()
            return
        self.state.update(state)
        self.handle.registerTimer(-(-deadline(state, self.p) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts_us", "event_id"])
        state, changes = self._get(), []
        for event in zip(events["ts_us"].tolist(), events["event_id"].tolist(), events["event"].tolist()):
            state, more = heard(state, event, self.p)
            changes += more
        self._put(state)
        yield _rows([(key[0], *c) for c in changes])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed, as a deadline may bring the next one with it
        state, changes = overdue(self._get(), timerValues.getCurrentWatermarkInMs() * 1000, self.p)
        self._put(state)
        if changes:
            yield _rows([(key[0], *c) for c in changes])


def job_changes_stream(events: DataFrame, p: Lifetimes = Lifetimes(), late: str = "1 hour") -> DataFrame:
    """R3-R5 on a stream of (job_id, event_id, ts, event); events later than ``late`` are left out by the watermark.

    The session's state store must be RocksDB's. A job's state goes when it is deleted.
    """
    timed = events.withWatermark("ts", late).withColumn("ts_us", F.unix_micros("ts"))
    return timed.groupBy("job_id").transformWithStateInPandas(Jobs(p), CHANGES, "append", "EventTime")


def job_changes(events: DataFrame, now_us: int | None = None, p: Lifetimes = Lifetimes()) -> DataFrame:
    """The same over a table of (job_id, event_id, ts_us, event), with what the clock does until ``now_us``.

    Without ``now_us`` it ends with the last event of all jobs. Events without a job or a time go. A job's
    events are one task's, in order; a job is bounded by its nature.
    """
    some = events.where("job_id is not null and ts_us is not null").select("job_id", "event_id", "ts_us", "event")
    if now_us is None:
        now_us = some.agg(F.max("ts_us")).first()[0] or 0

    def run(batches):
        job, state = None, None

        def end():
            return [(job, *c) for c in overdue(state, now_us, p)[1]] if job is not None else []

        for pdf in batches:
            out = []
            for job_id, event_id, ts, kind in zip(pdf["job_id"].tolist(), pdf["event_id"].tolist(), pdf["ts_us"].tolist(), pdf["event"].tolist()):
                if job_id != job:
                    out += end()
                    job, state = job_id, None
                state, changes = heard(state, (ts, event_id, kind), p)
                out += [(job_id, *c) for c in changes]
            if out:
                yield _rows(out)
        if last := end():
            yield _rows(last)

    return some.repartition("job_id").sortWithinPartitions("job_id", "ts_us", "event_id").mapInPandas(run, CHANGES)

"""Stateful operators over event streams; each has a batch form for tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ADMITTED = "key long, event_id long, ts_us long, allowed boolean"


def admit(times: list[int], arrivals: list[int], limit: int, window_us: int) -> tuple[list[bool], list[int]]:
    """Which arrivals a sliding limit lets in; refused ones do not count later."""
    held, out = list(times), []
    for t in arrivals:
        held = [x for x in held if x >= t - window_us]
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out, held


def rate_limit(events: DataFrame, limit: int, window_us: int) -> DataFrame:
    """R1 over a table (key, event_id, ts_us): one exchange and sort, then a scan that holds a key's open window only."""

    def run(batches):
        key, held = None, deque()
        for batch in batches:
            allowed = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    key, held = k, deque()
                while held and held[0] < t - window_us:
                    held.popleft()
                allowed.append(len(held) < limit)
                if allowed[-1]:
                    held.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_())], ["key", "event_id", "ts_us", "allowed"])

    ordered = events.select("key", "event_id", "ts_us").repartition("key").sortWithinPartitions("key", "ts_us", "event_id")
    return ordered.mapInArrow(run, ADMITTED)


def rate_limit_stream(events: DataFrame, limit: int, window_us: int) -> DataFrame:
    """R1 over a stream: the state of a key is the admitted times still in the window."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["ts_us", "event_id"])
        allowed, held = admit(held, pdf["ts_us"].tolist(), limit, window_us)
        state.update((held,))
        yield pd.DataFrame({"key": key[0], "event_id": pdf["event_id"], "ts_us": pdf["ts_us"], "allowed": allowed})

    return events.groupBy("key").applyInPandasWithState(step, ADMITTED, "held array<long>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Tumbling counts with a watermark: rows later than ``late`` are left out in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def latest_state(events: DataFrame) -> DataFrame:
    """The last status of each job (job_id, status, ts_us, event_id)."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts_us", "event_id")).alias("status"), F.max("ts_us").alias("updated_us"))


def expire(jobs: DataFrame, now_us: int, keep_us: int, idle_us: int) -> DataFrame:
    """Ended jobs past their keeping time go; active ones that were idle too long fail."""
    ended = F.col("status").isin("complete", "failed")
    act = F.when(ended & (F.col("updated_us") + keep_us <= now_us), "delete").when(~ended & (F.col("updated_us") <= now_us - idle_us), "fail").otherwise("keep")
    return jobs.withColumn("action", act)


def queue_order(jobs: DataFrame) -> DataFrame:
    """Place in the queue by time and id."""
    return jobs.withColumn("place", F.row_number().over(Window.orderBy("updated_us", "job_id")))

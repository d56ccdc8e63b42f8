import random

import pytest
from pyspark.sql import functions as F

from cuelake.streaming.jobs import Lifetimes, job_changes, job_changes_stream

MIN = 60_000_000
P = Lifetimes(idle_us=30 * MIN, keep_us=60 * MIN)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (r[0], r[1], r[2] is not None, r[2], r[3:]) if r[2] is not None else (r[0], r[1], False, 0, r[3:]))


def events(spark, what):
    return spark.createDataFrame(what, "job_id long, event_id long, ts_us long, event string")


def test_changes_refusals_and_deadlines(spark):
    e = [(1, 1, 0, "queue"), (1, 2, MIN, "claim"), (1, 3, 2 * MIN, "claim"), (1, 4, 3 * MIN, "interrupt"), (1, 5, 4 * MIN, "claim"), (1, 6, 5 * MIN, "complete"), (2, 7, 0, "queue"), (2, 8, 31 * MIN, "complete"), (3, 9, 0, "complete"), (4, 10, 0, "what")]
    got = [(r[0], r[1] // MIN, r[3], r[4], r[5]) for r in rows(job_changes(events(spark, e), 200 * MIN, P))]
    assert got == [
        (1, 0, None, "queued", "queue"), (1, 1, "queued", "processing", "claim"), (1, 2, "processing", "processing", "refused"), (1, 3, "processing", "queued", "interrupt"),
        (1, 4, "queued", "processing", "claim"), (1, 5, "processing", "complete", "complete"), (1, 65, "complete", "deleted", "expired"),
        (2, 0, None, "queued", "queue"), (2, 30, "queued", "failed", "idle"), (2, 31, "failed", "failed", "refused"), (2, 90, "failed", "deleted", "expired"),
        (3, 0, None, None, "refused"), (4, 0, None, None, "refused"),
    ]
    assert rows(job_changes(events(spark, []), None, P)) == []


def test_a_stream_tells_the_tables_story(spark, tmp_path):
    """Three batches out of order within the watermark, and one that is too late; timers fire between."""
    rng = random.Random(9)
    kinds = ["queue", "claim", "complete", "fail", "interrupt"]
    all_events = [(rng.randint(1, 12), i, (1000 + rng.randint(0, 240)) * MIN, rng.choice(kinds)) for i in range(200)]
    batches = [[e for e in all_events if lo <= e[2] // MIN - 1000 < hi] for lo, hi in ((0, 80), (80, 160), (160, 241))]
    last = [(99, 900, 1600 * MIN, "queue")]  # moves the watermark
    late = [(5, 901, 1001 * MIN, "queue")]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "job_id long, event_id long, ts timestamp, event string"
    source, n = tmp_path / "in", 0
    source.mkdir()
    query = None
    try:
        stream = spark.readStream.schema(schema).parquet(str(source))
        out = job_changes_stream(stream, P, "10 minutes").writeStream.format("memory").queryName("job_story").option("checkpointLocation", str(tmp_path / "c")).start()
        query = out
        for batch in [*batches, last, late, [(98, 902, 1601 * MIN, "queue")]]:
            rng.shuffle(batch)
            events(spark, batch).select("job_id", "event_id", F.timestamp_micros("ts_us").alias("ts"), "event").coalesce(1).write.mode("append").parquet(str(source))
            n += 1
            query.processAllAvailable()
    finally:
        if query is not None:
            query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [r for r in rows(spark.table("job_story")) if r[0] < 90]
    # the last watermark: ten minutes before the last event but one batch
    want = [r for r in rows(job_changes(events(spark, all_events), 1590 * MIN, P))]
    assert len(want) > 150 and got == want

"""Keyed state of streams: late corrections, repeats, restarts."""

import datetime as dt

import pytest

from tapewright.streaming import ingest, latest

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, d int, v double, arrived timestamp"


def row(k, d, v, hour):
    return (k, d, v, T0 + dt.timedelta(hours=hour))


@pytest.fixture
def feed(spark, tmp_path):
    def put(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.stream_table(spark, f"{tmp_path}/in", "*.parquet", SCHEMA)
        latest.log_changes(stream, f"{tmp_path}/log", f"{tmp_path}/progress", ("k", "d")).awaitTermination()
        return spark.read.parquet(f"{tmp_path}/log")

    return put


def test_late_corrections_win_and_repeats_end(feed, spark, tmp_path):
    log = feed(row("A", 1, 1.0, 0), row("A", 2, 5.0, 0), row("B", 1, 2.0, 0), row("A", 1, 1.5, 3), row(None, 1, 7.0, 0))
    assert {(r.k, r.d): r.v for r in latest.standing(log, ("k", "d")).collect()} == {("A", 1): 1.5, ("A", 2): 5.0, ("B", 1): 2.0, (None, 1): 7.0}
    # A restarted query, whose state is the checkpoint's: a correction, a stale arrival, a repeat, and nothing else is logged.
    log = feed(row("A", 1, 9.0, 8), row("A", 2, 4.0, -5), row("B", 1, 2.0, 9))
    assert log.count() == 5
    want = {("A", 1): 9.0, ("A", 2): 5.0, ("B", 1): 2.0, (None, 1): 7.0}
    assert {(r.k, r.d): r.v for r in latest.standing(log, ("k", "d")).collect()} == want
    latest.compact(log, f"{tmp_path}/compact", ("k", "d"))
    small = spark.read.parquet(f"{tmp_path}/compact")
    assert small.count() == 4 and {(r.k, r.d): r.v for r in latest.standing(small, ("k", "d")).collect()} == want


def test_keys_that_share_a_bucket_stay_apart(spark, tmp_path):
    """One call for all keys: corrections, repeats and stale arrivals of each are told apart over batches."""

    def put(*rows):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        stream = latest.changes(ingest.stream_table(spark, f"{tmp_path}/in", "*.parquet", SCHEMA), ("k", "d"), buckets=1)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/log").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{tmp_path}/log")

    put(*(row(str(i), i, float(i), 1) for i in range(300)))
    log = put(*(row(str(i), i, -float(i), 2) for i in range(1, 300, 3)), *(row(str(i), i, float(i), 2) for i in range(0, 300, 3)), *(row(str(i), i, 7.0, 0) for i in range(2, 300, 3)), row("0", 1, 1.0, 0))
    assert log.count() == 401
    want = {(str(i), i): -float(i) if i % 3 == 1 else float(i) for i in range(300)} | {("0", 1): 1.0}
    assert {(r.k, r.d): r.v for r in latest.standing(log, ("k", "d")).collect()} == want


def test_only_keys_not_seen_for_long_go():
    import numpy as np
    import pandas as pd

    class State:
        value, hasTimedOut, wait = None, False, None
        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)

        def update(self, value):
            self.value = value

        def remove(self):
            self.value = None

        def setTimeoutDuration(self, ms):
            self.wait = ms

    state, work = State(), latest._newest(60_000)
    frame = pd.DataFrame({"a": [1, 2, 2], "b": [0, 0, 0], "moment": [5, 5, 6], "digest": [1, 2, 3]})
    assert [r.digest for out in work((0,), iter([frame]), state) for r in out.itertuples()] == [1, 3]
    held = np.frombuffer(state.value[0], np.int64).reshape(-1, 6).copy()
    held[0, 5] -= 120_000  # the first key was last seen two minutes ago
    state.value = (held.tobytes(),)
    assert [r.digest for out in work((0,), iter([frame]), state) for r in out.itertuples()] == [1]
    held[:, 5] -= 240_000
    state.value, state.hasTimedOut = (held.tobytes(),), True
    assert list(work((0,), iter([]), state)) == [] and not state.exists

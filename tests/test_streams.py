"""Quiz runs on a stream and over a table."""

import datetime as dt
import random

import pytest

from millrace.streaming import quiz_runs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, player string, ordinal long, kind string, question int, correct boolean"


def event(seconds, player, kind, question=None, correct=None, ordinal=0):
    return (T0 + dt.timedelta(seconds=seconds), player, ordinal, kind, question, correct)


EVENTS = [
    event(0, "ann", "answer", None, True), event(1, "ann", "start"), event(2, "ann", "answer", 0, True),  # before the question is shown
    event(3, "ann", "shown", 0), event(4, "ann", "answer", 1, True), event(5, "ann", "answer", 0, False), event(6, "ann", "answer", 0, True),  # only the first answer counts
    event(7, "ann", "start"), event(8, "ann", "next"), event(9, "ann", "next"), event(10, "ann", "shown"), event(11, "ann", "answer", None, True),
    event(12, "ann", "shown", 0), event(13, "ann", "start"), event(14, "ann", "shown", 0),
    event(0, "bob", "start"), event(1, "bob", "shown"), event(2, "bob", "answer", 0, True), event(500, "bob", "shown", 1), event(501, "bob", "start"), event(502, "bob", "shown"),
    event(3, None, "start"), event(4, "eve", "next"),
]
WANT = [("ann", 1, "complete", 2, 1, 5, 1, 11), ("ann", 2, "expired", 0, 0, 0, 13, 114), ("bob", 1, "expired", 1, 1, 5, 0, 102)]


def rows(frame):
    return sorted((r["player"], r["run"], r["status"], r["answered"], r["correct"], r["score"], (r["started"] - T0).total_seconds(), (r["ended"] - T0).total_seconds()) for r in frame.collect())


def test_runs_of_a_table(spark):
    events = spark.createDataFrame(EVENTS, SCHEMA)
    assert rows(quiz_runs.runs_of(events, 2, 100)) == WANT
    assert rows(quiz_runs.runs_of(events.union(events), 2, 100)) == WANT  # repeated events change nothing here
    assert rows(quiz_runs.runs_of(events.limit(0), 2, 100)) == []


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_runs_of_a_stream_however_events_arrive(spark, tmp_path, rocksdb):
    """Shuffled within the watermark, over several batches, with one event that is too late."""
    rng = random.Random(4)
    early = [e for e in EVENTS if (e[0] - T0).total_seconds() < 60]
    rng.shuffle(early)
    late = event(2, "bob", "answer", 0, False)
    batches = [early[:9], early[9:], [e for e in EVENTS if e not in early], [event(5000, "zoe", "start")], [late], [event(5001, "zoe", "next")]]
    folder = str(tmp_path / "in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder + "/*")
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
        query = quiz_runs.live_runs(stream, 2, 100, "60 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    found = rows(spark.read.parquet(str(tmp_path / "out")))
    assert [r for r in found if r[0] != "bob"] == [r for r in WANT if r[0] != "bob"]
    assert [r for r in found if r[0] == "bob"] == [*[r for r in WANT if r[0] == "bob"], ("bob", 2, "expired", 0, 0, 0, 501, 602)]

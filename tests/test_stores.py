"""Commits, runs and what a batch reads of a long history."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from millrace.sources import commit_log, feeds
from millrace.streaming import history_stream

SCHEMA = "id string, v long"


def frame(spark, ids):
    return spark.createDataFrame([(f"k{i}", i) for i in ids], SCHEMA)


def test_one_of_two_writers_gets_a_number(spark, tmp_path):
    root = str(tmp_path / "log")
    assert commit_log.last_number(spark, root) == 0 and commit_log.runs(spark, root) == []

    def write(who):
        try:
            return commit_log.publish(spark, root, {"who": who}, 0)
        except commit_log.Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(write, range(8)))
    assert [n for n in got if n] == [1] and commit_log.read(spark, root, 1)["who"] == got.index(1)
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda w: commit_log.publish_next(spark, root, {"who": w}), range(12)))
    assert sorted(numbers) == list(range(2, 14)) and commit_log.last_number(spark, root) == 13
    assert {commit_log.read(spark, root, n)["who"] for n in range(2, 14)} == set(range(12))
    with pytest.raises(ValueError):
        commit_log.publish(spark, root, {}, 40)


def test_conditional_replacement(spark, tmp_path):
    root = str(tmp_path / "tables")
    feeds.replace_tables({"a": spark.range(2)}, root)
    seen = feeds.last_version(spark, root)
    feeds.replace_tables({"a": spark.range(3)}, root, after=seen)
    with pytest.raises(commit_log.Conflict):
        feeds.replace_tables({"a": spark.range(9)}, root, after=seen)
    assert feeds.current_table(spark, root, "a").count() == 3


def test_versions_written_before_the_log_are_read(spark, tmp_path):
    root = str(tmp_path / "old")
    spark.range(4).write.parquet(f"{root}/abc/a")
    spark.createDataFrame([(1, "abc")], "number long, version string").write.parquet(f"{root}/versions")
    assert feeds.current_table(spark, root, "a").count() == 4
    feeds.replace_tables({"a": spark.range(5)}, root)
    assert feeds.current_table(spark, root, "a").count() == 5


def test_runs_are_merged_and_ids_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commit_log, "ROWS_A_BUCKET", 50)
    root, read = str(tmp_path / "store"), []
    for batch in range(20):
        ids = range(batch * 60, batch * 60 + 60)
        after = commit_log.last_number(spark, root)
        asked = frame(spark, [batch * 60, 3])
        near = commit_log.rows_beside(asked, root, SCHEMA, after) if after else None
        if near is not None:
            assert "k3" in {r["id"] for r in near.collect()}
            read.append((len(near.inputFiles()), near.count()))
        run = commit_log.write_run(frame(spark, ids), root, 0, 60)
        commit_log.publish_runs(spark, root, [*commit_log.runs(spark, root, after), run], after)
        while commit_log.compact(spark, root, SCHEMA) is not None:
            pass
    now = commit_log.runs(spark, root)
    assert sorted(r.level for r in now) == [1, 2] and sum(r.rows for r in now) == 1200
    assert sorted(r["v"] for r in commit_log.rows(spark, root, SCHEMA).collect()) == list(range(1200))
    assert max(n for _, n in read[-5:]) <= 2 * 50 * 2 * 4 and max(f for f, _ in read) <= 2 * 6  # two ids, a few runs
    before = commit_log.remove_unused(spark, root)
    assert before > 0 and commit_log.remove_unused(spark, root) == 0 and commit_log.rows(spark, root, SCHEMA).count() == 1200


def record(ordinal, key, correct):
    return {"ordinal": ordinal, "id": key, "completedAt": "2024-01-01T00:00:00Z", "seasonId": "s", "patch": "p", "correctCount": correct, "totalQuestions": 20, "score": correct * 5, "winRate": correct * 5.0}


def test_two_streams_write_one_store(spark, tmp_path):
    store = str(tmp_path / "store")
    for name in "ab":
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text("\n".join(json.dumps(record(i, f"{'ab'[i % 2]}{i}", 3)) for i in range(6)))
    both = [history_stream.ingest(history_stream.record_stream(spark, str(tmp_path / n)), store, str(tmp_path / f"check-{n}")) for n in "ab"]
    for query in both:
        query.awaitTermination(120)
        assert query.exception() is None
    assert sorted(r["id"] for r in history_stream.stored_history(spark, store).collect()) == ["a0", "a2", "a4", "b1", "b3", "b5"]
    assert commit_log.last_number(spark, store) == 2


def test_a_store_of_the_earlier_layout_is_taken_over(spark, tmp_path):
    store, source = str(tmp_path / "store"), tmp_path / "in"
    source.mkdir()
    schema = history_stream._STORED
    old = spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(record(0, "old", 1))]))
    old.write.parquet(f"{store}/data-0")
    spark.createDataFrame([(0, f"{store}/data-0")], "batch long, path string").write.parquet(f"{store}/versions")
    (source / "1.json").write_text("\n".join(json.dumps(record(i, k, 7)) for i, k in enumerate(("old", "new"))))
    history_stream.ingest(history_stream.record_stream(spark, str(source)), store, str(tmp_path / "check")).awaitTermination(120)
    assert sorted((r["id"], r["correctCount"]) for r in history_stream.stored_history(spark, store).collect()) == [("new", 7), ("old", 1)]

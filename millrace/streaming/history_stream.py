"""Score records as a stream: idempotent ingestion and live scores."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import RECORD_SCHEMA, save
from ..sources import commit_log


def record_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(f"{RECORD_SCHEMA}, ordinal BIGINT").json(folder)


_STORED = f"{RECORD_SCHEMA}, ordinal BIGINT"


def _earlier_batches(spark: SparkSession, store: str) -> DataFrame:
    """The records of a store's earlier layout, (batch, path) in ``versions``; none without it."""
    try:
        named = spark.read.parquet(f"{store}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # only a store without such a table has none
            raise
        return spark.createDataFrame([], _STORED)
    paths = [r["path"] for r in named.groupBy("batch").agg(F.max("path").alias("path")).collect()]
    return spark.read.schema(_STORED).parquet(*paths)


def stored_history(spark: SparkSession, store: str) -> DataFrame:
    """The records of all stored batches; a missing data folder is an error."""
    return commit_log.rows(spark, store, _STORED) if commit_log.last_number(spark, store) else _earlier_batches(spark, store)


def ingest(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Add each batch's new records; a record whose id is stored already changes nothing.

    A batch is written as a run and then published with its number: a failed batch
    leaves the store as it was, a repeated one is not taken again, and of two
    writers the one that is late reads what the other has added and tries again.
    A batch reads the buckets of its own ids only, and runs are merged as they
    gather, so what it reads does not grow with the history. A store of the
    earlier layout is taken over by its first batch.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        valid = save(spark.createDataFrame([], _STORED), batch).drop("completed").select(*[c.split()[0] for c in _STORED.split(", ")])
        rows = valid.count()
        while True:
            after = commit_log.last_number(spark, store)
            done = commit_log.read(spark, store, after).get("batches", {}) if after else {}
            if done.get(checkpoint, -1) >= number:
                return
            known = commit_log.rows_beside(valid, store, _STORED, after) if after else _earlier_batches(spark, store)
            fresh = valid.join(known.select("id"), "id", "left_anti").select(*valid.columns)
            added = commit_log.write_run(fresh, store, 0, rows)
            kept = commit_log.runs(spark, store, after)
            if not after and (earlier := _earlier_batches(spark, store)).head(1):
                kept = [commit_log.write_run(earlier, store, 1, earlier.count())]
            try:
                commit_log.publish_runs(spark, store, [*kept, added], after, batches={**done, checkpoint: number})
            except commit_log.Conflict:
                continue
            break
        while True:
            try:
                if commit_log.compact(spark, store, _STORED) is None:
                    return
            except commit_log.Conflict:  # the other writer merges, or the next batch does
                return

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_scores(answers: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Answers (ts, player, correct) to scores for each player and time window, with late rows up to a bound."""
    return (
        answers.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "player")
        .agg(F.count("*").alias("answered"), F.count_if("correct").alias("correct"))
        .select("window.start", "player", "answered", "correct", F.floor(F.col("correct") * 100.0 / F.col("answered") + 0.5).alias("rate"))
    )

"""Score histories: validation, idempotent saving, merging, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text
from .ordering import first_per_key, last_per_key, local_order

RECORD_SCHEMA = (
    "id STRING, completedAt STRING, seasonId STRING, patch STRING, correctCount INT, totalQuestions INT, score INT, winRate DOUBLE"
)


def make_records(answers: DataFrame) -> DataFrame:
    """Records from (id, completedAt, seasonId, patch, correctCount): totals are derived."""
    return answers.select(
        text.trimmed(F.col("id")).alias("id"),
        "completedAt",
        text.trimmed(F.col("seasonId")).alias("seasonId"),
        text.trimmed(F.col("patch")).alias("patch"),
        "correctCount",
        F.lit(numbers.QUESTIONS).alias("totalQuestions"),
        (F.col("correctCount") * numbers.POINTS).alias("score"),
        numbers.win_rate(F.col("correctCount")).alias("winRate"),
    )


def is_valid_record():
    """Bounds, a real instant, names that are not blank, and totals that follow from the answers."""
    c = F.col("correctCount")
    return F.coalesce(
        c.between(0, numbers.QUESTIONS)
        & text.stamp(F.col("completedAt")).isNotNull()
        & (F.length(text.trimmed(F.col("id"))) > 0)
        & (F.length(text.trimmed(F.col("seasonId"))) > 0)
        & (F.length(text.trimmed(F.col("patch"))) > 0)
        & (F.col("totalQuestions") == numbers.QUESTIONS)
        & (F.col("score") == c * numbers.POINTS)
        & (F.col("winRate") == c * 100.0 / numbers.QUESTIONS),
        F.lit(False),
    )


def valid_records(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Valid rows, the first of each id, with their instant; malformed rows are left out."""
    kept = rows.where(is_valid_record()).withColumn("id", text.trimmed(F.col("id")))
    return first_per_key(kept, "id", ordinal).withColumn("completed", text.stamp(F.col("completedAt")))


def in_order(records: DataFrame) -> DataFrame:
    return records.orderBy("completed", local_order("id"))


def save(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Append; an id that is there already keeps its stored record."""
    both = existing.drop("completed").withColumn("_new", F.lit(0)).unionByName(new.drop("completed").withColumn("_new", F.lit(1)))
    return first_per_key(both.where(is_valid_record()), "id", "_new", "ordinal").drop("_new").withColumn("completed", text.stamp(F.col("completedAt")))


def merge_last_wins(groups: list[DataFrame]) -> DataFrame:
    """Union of groups; of equal ids the last group's last record stays."""
    both = None
    for i, group in enumerate(groups):
        part = group.withColumn("_group", F.lit(i))
        both = part if both is None else both.unionByName(part)
    return last_per_key(both.withColumn("_at", F.struct("_group", "ordinal")), "id", "_at").drop("_group", "_at")


def summary(records: DataFrame) -> DataFrame:
    """One row over valid records; zeros when there are none."""
    return records.agg(
        F.count("*").alias("completed_sets"),
        F.coalesce(F.sum("correctCount"), F.lit(0)).alias("total_correct"),
        F.coalesce(F.sum("totalQuestions"), F.lit(0)).alias("total_questions"),
        F.coalesce(F.try_divide(F.sum("correctCount").cast("double"), F.sum("totalQuestions").cast("double")) * 100, F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.max("score"), F.lit(0)).alias("best_score"),
    )

"""Preference formatting of chosen and rejected conversations, with DataFrame functions only.

The longest common prefix of turns is rendered once as the prompt; what follows
in either conversation is its completion. Only the assistant's words in a
completion are to be learnt; everything else is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TURN_OPEN, TURN_CLOSE = "<|turn|>", "<|end|>"
LEARNT_ROLE = "assistant"


def safe(text: Column) -> Column:
    """Text in which a marker's opening cannot occur; null is empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def conversation_turns(frame: DataFrame, key: str, into: str) -> DataFrame:
    """One row for each conversation: its turns in order, ties by role and text."""
    turn = F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    said = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return frame.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("pair_id")).agg(said.alias(into))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations share from the start: equal roles and equal texts."""
    alike = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first_other = F.array_position(alike, False)
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(alike)).cast("int")


def rendered(turns: Column) -> Column:
    return F.concat_ws(
        "",
        F.transform(
            turns, lambda t: F.concat(F.lit(TURN_OPEN), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit(TURN_CLOSE + "\n"))
        ),
    )


def learnt_spans(turns: Column) -> Column:
    """Spans [start, end) of the rendered text that are not masked: each assistant turn's words and its end."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + len(TURN_OPEN) + F.char_length(safe(t["role"])) + 1
        end = begin + F.char_length(safe(t["text"])) + len(TURN_CLOSE)
        span = F.array(F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct(
            (end + 1).cast("int").alias("at"),
            F.when(t["role"] == LEARNT_ROLE, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """Paired masked completions of two tables of turns (key, turn, role, text).

    Returns pair_id, n_common, prompt, chosen, chosen_spans, rejected,
    rejected_spans. Spans are offsets in code points. A pair needs both sides; a
    null key pairs with nothing; null roles and texts count as empty; equal
    conversations have empty completions; without a common turn the prompt is
    empty; repeated rows are turns of their own. No rows give no rows.
    """
    both = conversation_turns(chosen, key, "c").join(conversation_turns(rejected, key, "r"), "pair_id")
    n = common_turns(F.col("c"), F.col("r"))
    cut = both.withColumn("n_common", n).select(
        "pair_id",
        "n_common",
        F.slice("c", F.lit(1), F.col("n_common")).alias("p"),
        F.slice("c", F.col("n_common") + 1, F.greatest(F.size("c"), F.lit(1))).alias("c"),
        F.slice("r", F.col("n_common") + 1, F.greatest(F.size("r"), F.lit(1))).alias("r"),
    )
    return cut.select(
        "pair_id",
        "n_common",
        rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"),
        learnt_spans(F.col("c")).alias("chosen_spans"),
        rendered(F.col("r")).alias("rejected"),
        learnt_spans(F.col("r")).alias("rejected_spans"),
    )


def next_answer_pairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from one table of conversations.

    Chosen is a conversation as it stands. Rejected is the same one with its last
    assistant turn answered by the last assistant turn of the conversation whose
    id is one higher (with no such conversation or answer: by an empty text). A
    conversation without an assistant turn makes no pair.
    """
    answers = (
        turns.where(F.col("role") == LEARNT_ROLE)
        .groupBy("conv_id")
        .agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
        .where("conv_id IS NOT NULL")
    )
    own = answers.select("conv_id", F.col("last.turn").alias("last_turn"))
    other = answers.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("other_text"))
    swap = own.join(other, "conv_id", "left")
    sides = turns.join(swap, "conv_id").select("conv_id", "turn", "role", "text", "last_turn", F.coalesce("other_text", F.lit("")).alias("other_text"))
    chosen = sides.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    swapped = F.when((F.col("turn") == F.col("last_turn")) & (F.col("role") == LEARNT_ROLE), F.col("other_text")).otherwise(F.col("text"))
    return chosen, sides.select(F.col("conv_id").alias("pair_id"), "turn", "role", swapped.alias("text"))


def _spans_text(spans: Column) -> Column:
    return F.concat_ws(";", F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))))


def preference_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against the next one, as pairs with digests; ids are whole numbers, nulls, ties and empty tables are
    as in ``preference_pairs``."""
    turns = common.plain(common.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return preference_pairs(*next_answer_pairs(turns)).select(
        F.col("pair_id").alias("conv_id"),
        "n_common",
        "prompt",
        "chosen",
        _spans_text(F.col("chosen_spans")).alias("chosen_spans"),
        "rejected",
        _spans_text(F.col("rejected_spans")).alias("rejected_spans"),
    )


#: The same pairs, written anew for DuckDB.
ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), last_answer AS (
  SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS last_text FROM t WHERE role = 'assistant' GROUP BY conv_id
), sides AS (
  SELECT t.conv_id, t.turn, t.role, t.text AS chosen,
         CASE WHEN t.turn = o.last_turn AND t.role = 'assistant' THEN coalesce(n.last_text, '') ELSE t.text END AS rejected
  FROM t JOIN last_answer o USING (conv_id) LEFT JOIN last_answer n ON n.conv_id = o.conv_id + 1
), flagged AS (
  SELECT *, coalesce(min(CASE WHEN chosen <> rejected THEN turn END) OVER (PARTITION BY conv_id), 1000000000) AS first_other FROM sides
), made AS (
  SELECT *, turn < first_other AS shared,
         '<|turn|>' || replace(role, '<|', '< |') || chr(10) AS head,
         replace(chosen, '<|', '< |') || '<|end|>' AS c_body, replace(rejected, '<|', '< |') || '<|end|>' AS r_body
  FROM flagged
), placed AS (
  SELECT *,
         coalesce(sum(length(head) + length(c_body) + 1) OVER w, 0) + length(head) AS c_at,
         coalesce(sum(length(head) + length(r_body) + 1) OVER w, 0) + length(head) AS r_at
  FROM made
  WINDOW w AS (PARTITION BY conv_id, shared ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT conv_id, count(*) FILTER (shared)::INT AS n_common,
       coalesce(string_agg(head || c_body || chr(10), '' ORDER BY turn) FILTER (shared), '') AS prompt,
       coalesce(string_agg(head || c_body || chr(10), '' ORDER BY turn) FILTER (NOT shared), '') AS chosen,
       coalesce(string_agg(c_at::BIGINT || '-' || (c_at + length(c_body))::BIGINT, ';' ORDER BY turn) FILTER (NOT shared AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(head || r_body || chr(10), '' ORDER BY turn) FILTER (NOT shared), '') AS rejected,
       coalesce(string_agg(r_at::BIGINT || '-' || (r_at + length(r_body))::BIGINT, ';' ORDER BY turn) FILTER (NOT shared AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY conv_id
"""

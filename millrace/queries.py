"""Queries over the driver's tables, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import numbers, text
from .operators import catalog, etl, evaluation, history, matching, ordering, quiz, selection, validation, vision
from .streaming import history_stream, quiz_runs

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- recognition outcomes --------------------------------------------------

@query("""
WITH e AS (
  SELECT CASE event_type WHEN 'click' THEN 'game' WHEN 'view' THEN 'splash' END AS category,
         CASE event_id % 4 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'unavailable' ELSE 'match' END AS status,
         CASE WHEN user_id % 7 > 0 THEN user_id % 7 END AS expected, CASE WHEN event_id % 7 > 0 THEN event_id % 7 END AS predicted,
         value AS recognition_ms, CASE WHEN event_id % 5 > 0 THEN value / 4 END AS decode_ms
  FROM events
), c AS (SELECT unnest(['game', 'splash', 'unknown']) AS category)
SELECT category, count(e.status) AS n, count(*) FILTER (status = 'match') AS decided, count(*) FILTER (status = 'uncertain') AS uncertain,
  count(*) FILTER (status = 'unavailable') AS unavailable,
  CASE WHEN category <> 'unknown' THEN count(*) FILTER (status = 'match' AND expected IS NOT DISTINCT FROM predicted) END AS top1_correct,
  CASE WHEN category <> 'unknown' AND count(e.status) > 0 THEN count(*) FILTER (status = 'match' AND expected IS NOT DISTINCT FROM predicted) / count(e.status) END AS top1_rate,
  CASE WHEN category <> 'unknown' THEN count(*) FILTER (status = 'match' AND expected IS DISTINCT FROM predicted) END AS wrong_decisions,
  CASE WHEN category <> 'unknown' THEN count(DISTINCT expected) + max(CASE WHEN status IS NOT NULL AND expected IS NULL THEN 1 ELSE 0 END) END AS distinct_labels,
  CASE WHEN category = 'unknown' THEN count(*) FILTER (status = 'match') END AS false_positives,
  CASE WHEN category = 'unknown' AND count(e.status) > 0 THEN count(*) FILTER (status = 'match') / count(e.status) END AS false_positive_rate,
  round(quantile_disc(recognition_ms, 0.5)::DECIMAL(38,15), 1)::DOUBLE AS recognition_ms_median,
  round(quantile_disc(recognition_ms, 0.95)::DECIMAL(38,15), 1)::DOUBLE AS recognition_ms_p95, round(max(recognition_ms)::DECIMAL(38,15), 1)::DOUBLE AS recognition_ms_max,
  round(quantile_disc(decode_ms, 0.5)::DECIMAL(38,15), 1)::DOUBLE AS decode_ms_median,
  round(quantile_disc(decode_ms, 0.95)::DECIMAL(38,15), 1)::DOUBLE AS decode_ms_p95, round(max(decode_ms)::DECIMAL(38,15), 1)::DOUBLE AS decode_ms_max
FROM c LEFT JOIN e USING (category) GROUP BY category""")
def evaluation_summary(spark, sf_dir):
    """Outcomes by category; one of the three has no rows."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.when(F.col("event_type") == "click", "game").when(F.col("event_type") == "view", "splash").alias("category"),
        F.when(F.col("event_id") % 4 == 0, "uncertain").when(F.col("event_id") % 4 == 1, "unavailable").otherwise("match").alias("status"),
        F.when(F.col("user_id") % 7 > 0, F.col("user_id") % 7).alias("expected"),
        F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 7).alias("predicted"),
        F.col("value").alias("recognition_ms"),
        F.when(F.col("event_id") % 5 > 0, F.col("value") / 4).alias("decode_ms"),
    )
    return evaluation.summarize(rows)


@query("""
SELECT event_type, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY event_type""")
def nearest_rank_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return evaluation.nearest_ranks(e, ["event_type"], "value", {"median": 0.5, "p95": 0.95, "most": 1.0})


@query("""
WITH m AS (SELECT doc_id, sha256(text) AS sha256 FROM documents)
SELECT sha256, count(*) AS copies, min(doc_id) AS first_doc FROM m GROUP BY sha256 HAVING count(*) > 1""")
def duplicate_content(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return d.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("""
WITH d AS (SELECT doc_id, text, doc_id % 3 = 0 AS is_case FROM documents), m AS (SELECT *, sha256(text) AS h FROM d WHERE is_case)
SELECT doc_id, 'reference' AS repeats FROM m WHERE h IN (SELECT sha256(text) FROM d WHERE NOT is_case)
UNION ALL SELECT doc_id, 'case' AS repeats FROM m WHERE h IN (SELECT h FROM m GROUP BY h HAVING count(*) > 1)""")
def reused_content(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    cases = d.where("doc_id % 3 = 0")
    return evaluation.reused_content(cases, d.where("doc_id % 3 <> 0"), "text").select("doc_id", "repeats")


# --- histories -------------------------------------------------------------

@query("""
SELECT event_id, user_id, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS hits, count(*) OVER w AS seen,
  CAST(floor(CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER w AS DOUBLE) * 100 / count(*) OVER w + 0.5) AS BIGINT) AS rate
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_hit_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return ordering.running_rate(e, "user_id", F.col("value") > 50, "ts", "event_id").select("event_id", "user_id", "hits", "seen", "rate")



@query("""SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def first_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return ordering.first_per_key(e, ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("""
WITH g AS (SELECT event_id % 5000 AS id, value, 0 AS grp, event_id AS ordinal FROM events WHERE event_id % 3 <> 0
  UNION ALL SELECT event_id % 5000, value, 1, event_id FROM events WHERE event_id % 3 = 0)
SELECT id, value, ordinal FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY grp DESC, ordinal DESC) = 1""")
def merge_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 5000).alias("id"), "value", F.col("event_id").alias("ordinal"))
    return history.merge_last_wins([e.where("ordinal % 3 <> 0"), e.where("ordinal % 3 = 0")])


@query("""SELECT user_id, event_id, ordinal FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS ordinal, count(*) OVER (PARTITION BY user_id) AS n FROM events)
WHERE ordinal > n - 10""")
def recent_ten(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return ordering.recent(e, "user_id", 10, "ts", "event_id").drop("ts")


_RECORDS_SQL = """
WITH r AS (
  SELECT CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'set-' || (event_id // 2) END AS id, event_id AS ordinal,
         CAST(floor(value) AS BIGINT) % 23 AS c, CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS off
  FROM events
), v AS (
  SELECT * FROM r WHERE c BETWEEN 0 AND 20 AND trim(id) <> '' AND off = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal) = 1)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score records made from events: every eleventh without an id, every thirteenth with a wrong total."""
    e = table(spark, sf_dir, "events")
    c = (F.floor("value") % 23).cast("int")
    return e.select(
        F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.concat(F.lit("set-"), F.floor(F.col("event_id") / 2).cast("string"))).alias("id"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("completedAt"),
        F.lit("s1").alias("seasonId"),
        F.lit("1.0").alias("patch"),
        c.alias("correctCount"),
        F.lit(20).alias("totalQuestions"),
        (c * 5 + F.when(F.col("event_id") % 13 == 0, 1).otherwise(0)).cast("int").alias("score"),
        (c * 100.0 / 20).alias("winRate"),
        F.col("event_id").alias("ordinal"),
    )


@query(_RECORDS_SQL + "SELECT id, ordinal, c::INT AS correct FROM v")
def valid_records(spark, sf_dir):
    return history.valid_records(_records(spark, sf_dir)).select("id", "ordinal", F.col("correctCount").alias("correct"))


@query(_RECORDS_SQL + """SELECT count(*) AS completed_sets, CAST(coalesce(sum(c), 0) AS BIGINT) AS total_correct, CAST(count(*) * 20 AS BIGINT) AS total_questions,
  coalesce(CAST(sum(c) AS DOUBLE) / CAST(count(*) * 20 AS DOUBLE) * 100, 0) AS win_rate, CAST(coalesce(max(c) * 5, 0) AS INT) AS best_score FROM v""")
def history_summary(spark, sf_dir):
    return history.summary(history.valid_records(_records(spark, sf_dir)))


@query("""SELECT event_id, user_id, event_type FROM events
QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type""")
def adjacent_repeats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return ordering.adjacent_repeats(e, "user_id", "event_type", "ts", "event_id").drop("ts")


@query("""
WITH t AS (SELECT event_id, value, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 10)
SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) / (count(*) OVER () - 1) AS x, 1 - value / 100 AS y FROM t""")
def chart_points(spark, sf_dir):
    """A report of the ten last sets."""
    e = table(spark, sf_dir, "events").select("event_id", "value", "ts")
    return ordering.chart_points(e, "value", F.col("ts"), F.col("event_id")).select("event_id", "x", "y")


# --- selection and layout ----------------------------------------------------

@query("""
SELECT o_custkey, o_orderkey, rank::INT AS rank FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey
    ORDER BY (o_orderpriority = '1-URGENT') DESC, (o_orderstatus = 'O') DESC, o_totalprice DESC, o_orderkey) AS rank
  FROM orders WHERE o_orderstatus IN ('O', 'F')) WHERE rank <= 3""")
def priority_top3(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "F"))
    order = [(F.col("o_orderpriority") == "1-URGENT").desc(), (F.col("o_orderstatus") == "O").desc(), F.desc("o_totalprice"), "o_orderkey"]
    return ordering.top_per_key(o.select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"), "o_custkey", 3, *order).select("o_custkey", "o_orderkey", "rank")


@query("""
SELECT p_size AS cost, count(*) AS count, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS members FROM part
WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1') GROUP BY p_size""")
def haystack_search(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    heroes = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("traits"), F.col("p_size").alias("cost"), F.col("p_partkey").alias("ordinal"))
    found = selection.grouped_by_cost(selection.search(heroes, "  BRAND#1 "))
    return found.select("cost", "count", F.concat_ws(",", F.transform("members", lambda m: m["id"])).alias("members"))


_SLOT_SQL = "SELECT *, (l_partkey % 6)::INT AS r, (l_suppkey % 9)::INT AS c FROM lineitem"


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as members of a formation; rows 0 and 5 and columns 0 and 8 are off the board."""
    position = F.struct((F.col("l_partkey") % 6).cast("int").alias("row"), (F.col("l_suppkey") % 9).cast("int").alias("column"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ordinal"), F.col("l_partkey").cast("string").alias("name"), position.alias("position"))


@query(f"""
WITH s AS ({_SLOT_SQL}), b AS (SELECT (i // 7 + 1)::INT AS "row", (i % 7 + 1)::INT AS "column" FROM range(28) t(i))
SELECT b."row", b."column", count(s.l_orderkey) AS occupants FROM b LEFT JOIN s ON s.r = b."row" AND s.c = b."column" GROUP BY ALL""")
def board_occupancy(spark, sf_dir):
    """All 28 cells with how many members stand on them."""
    return selection.occupancy(_slots(spark, sf_dir), spark)


@query(f"""
WITH s AS ({_SLOT_SQL})
SELECT l_orderkey, r AS "row", c AS "column", string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS members
FROM s WHERE r BETWEEN 1 AND 4 AND c BETWEEN 1 AND 7 GROUP BY l_orderkey, r, c""")
def board_layout(spark, sf_dir):
    """Every order's board."""
    return selection.layout_each(_slots(spark, sf_dir), "l_orderkey").withColumn("members", F.concat_ws(",", "members"))


@query(f"WITH s AS ({_SLOT_SQL}) SELECT count(*) AS unplaced FROM s WHERE NOT (r BETWEEN 1 AND 4 AND c BETWEEN 1 AND 7)")
def board_unplaced(spark, sf_dir):
    return selection.layout(_slots(spark, sf_dir), spark)[1].agg(F.count("*").alias("unplaced"))


@query("""SELECT DISTINCT c.c_custkey FROM customer c JOIN supplier s ON c.c_custkey = s.s_suppkey OR (c.c_mktsegment = 'BUILDING' AND c.c_nationkey = s.s_nationkey AND s.s_acctbal > 9000)""")
def either_match(spark, sf_dir):
    """Two equalities joined by OR, as two hash joins."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    conditions = [
        F.col("c_custkey") == F.col("s_suppkey"),
        (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_mktsegment") == "BUILDING") & (F.col("s_acctbal") > 9000),
    ]
    return selection.match_either(c, s, conditions, "c_custkey").select("c_custkey")


@query("""SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def counts_with_zero(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"))  # summed before the join
    return c.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("orders"))


@query("""SELECT c_mktsegment, count(*) AS customers FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) GROUP BY c_mktsegment""")
def semi_join_counts(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 100000")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


@query("""
SELECT p_partkey AS id, 'local' AS origin, p_name AS name FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT p_partkey, 'public', p_brand FROM part WHERE p_size > 20 AND NOT p_partkey % 4 = 0""")
def precedence_union(spark, sf_dir):
    """Local rows first; public ones only for keys that are missing."""
    p = table(spark, sf_dir, "part")
    local = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id"), F.lit("local").alias("origin"), F.col("p_name").alias("name"))
    public = p.where("p_size > 20").select(F.col("p_partkey").alias("id"), F.lit("public").alias("origin"), F.col("p_brand").alias("name"))
    return catalog.with_precedence(local, public, ["id"])


@query("""SELECT DISTINCT p_size AS cost FROM part""")
def distinct_costs(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("cost")).distinct().orderBy("cost")


@query("""
WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
SELECT w.l_orderkey, w.l_linenumber, p.p_name AS right_name, s.s_name AS chosen_name FROM w LEFT JOIN part p ON p_partkey = l_partkey LEFT JOIN supplier s ON s_suppkey = l_suppkey""")
def wrong_answers(spark, sf_dir):
    """Facts of one kind with two dimensions."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("right_name"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("chosen_name"))
    return li.join(p, li["l_partkey"] == p["p_partkey"], "left").join(s, li["l_suppkey"] == s["s_suppkey"], "left").select("l_orderkey", "l_linenumber", "right_name", "chosen_name")


# --- rules -------------------------------------------------------------------

@query("""
SELECT path, reason, count(*) AS n FROM (
  SELECT 'acctbal' AS path, 'negative balance' AS reason FROM customer WHERE NOT coalesce(c_acctbal >= 0, false)
  UNION ALL SELECT 'segment', 'unknown segment' FROM customer WHERE NOT coalesce(c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY'), false)
  UNION ALL SELECT 'name', 'bad name' FROM customer WHERE NOT coalesce(regexp_matches(c_name, '^Customer#[0-9]*[02468]$'), false)) GROUP BY ALL""")
def rule_violations(spark, sf_dir):
    rules = [
        (F.col("c_acctbal") >= 0, F.lit("acctbal"), "negative balance"),
        (F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY"), F.lit("segment"), "unknown segment"),
        (text.matches(F.col("c_name"), "^Customer#[0-9]*[02468]$"), F.lit("name"), "bad name"),
    ]
    return validation.violations(table(spark, sf_dir, "customer"), rules).groupBy("path", "reason").agg(F.count("*").alias("n"))


@query("""SELECT 'order ' || o_orderkey AS path, 'unknown customer' AS reason FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def unknown_references(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return validation.unknown_references(o, "o_custkey", c, "c_custkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), "unknown customer")


@query("""SELECT conv_id, turn, count(*) AS n FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT count(*) AS n, count(*) FILTER (quality IS NULL OR toxic IS NULL) AS missing, count(DISTINCT doc_id) AS ids FROM labels""")
def missing_labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull() | F.col("toxic").isNull()).alias("missing"), F.count_distinct("doc_id").alias("ids"))


@query("""
SELECT page_id, regexp_matches(url, '^https://') AS https, regexp_matches(url, '^[a-z]+://[^/?#]+/[a-z]{2}/[0-9]+$') AS plain,
  NOT list_contains(string_split(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/'), '') AS whole_path FROM pages""")
def safe_urls(spark, sf_dir):
    path = F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", text.is_https(F.col("url")).alias("https"), text.matches(F.col("url"), "^[a-z]+://[^/?#]+/[a-z]{2}/[0-9]+$").alias("plain"),
        (~F.exists(F.split(path, "/"), lambda p: p == "")).alias("whole_path"),
    )


# --- feeds -------------------------------------------------------------------

@query(r"""SELECT page_id, length(regexp_replace(regexp_replace(html, '<br\s*/?\s*>', chr(10), 'gi'), '<[^>]*>', '', 'g')) AS n_chars FROM pages""")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.char_length(text.without_tags(F.col("html"))).cast("long").alias("n_chars"))


@query(r"""
SELECT page_id, md5(trim(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '<br\s*/?\s*>', chr(10), 'gi'), '<[^>]*>', '', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), ' ' || chr(10))) AS digest FROM pages""")
def plain_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.plain_text(F.col("html")).cast("binary")).alias("digest"))


@query("""
SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1""")
def json_histogram(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, (l_partkey % 6) || ',' || (l_suppkey % 9) AS pos FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN split_part(pos, ',', 1)::INT END AS "row", CASE WHEN ok THEN split_part(pos, ',', 2)::INT END AS "column", NOT ok AS bad
FROM (SELECT *, regexp_matches(pos, '^[1-4],[1-7]$') AS ok FROM x)""")
def grid_positions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pos = F.concat((F.col("l_partkey") % 6).cast("string"), F.lit(","), (F.col("l_suppkey") % 9).cast("string"))
    x = li.select("l_orderkey", "l_linenumber", pos.alias("pos"))
    at = text.grid_position(F.col("pos"))
    return x.select("l_orderkey", "l_linenumber", at["row"].alias("row"), at["column"].alias("column"), text.bad_position(F.col("pos")).alias("bad"))


@query("""
WITH x AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN '-3' ELSE c_acctbal::VARCHAR END AS raw FROM customer)
SELECT c_custkey, CASE WHEN raw <> '' AND try_cast(raw AS DOUBLE) >= 0 THEN try_cast(raw AS DOUBLE) END AS number FROM x""")
def nonnegative_numbers(spark, sf_dir):
    k = F.col("c_custkey") % 5
    raw = F.when(k == 0, "").when(k == 1, "n/a").when(k == 2, "-3").otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")).select("c_custkey", numbers.nonnegative(F.col("raw")).alias("number"))


@query("""
WITH names AS (SELECT n_nationkey::VARCHAR AS k, n_name AS v FROM nation),
x AS (SELECT s_suppkey, unnest(['0', (s_suppkey % 25)::VARCHAR, '-1', (s_suppkey % 7)::VARCHAR, (s_suppkey % 25)::VARCHAR, '']) AS k, unnest(range(6)) AS i FROM supplier)
SELECT s_suppkey, coalesce(string_agg(v, '|' ORDER BY i), '') AS names FROM (
  SELECT s_suppkey, v, min(i) AS i FROM x JOIN names USING (k) WHERE k NOT IN ('', '0', '-1') GROUP BY ALL) GROUP BY s_suppkey
UNION ALL SELECT s_suppkey, '' FROM supplier WHERE s_suppkey % 25 = 0 AND s_suppkey % 7 = 0""")
def trait_names(spark, sf_dir):
    """Listed ids to names, in order, each once."""
    n = table(spark, sf_dir, "nation").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name"))).alias("names"))  # 25 rows
    k = F.col("s_suppkey")
    ids = F.concat_ws("|", F.lit("0"), (k % 25).cast("string"), F.lit("-1"), (k % 7).cast("string"), (k % 25).cast("string"), F.lit(""))
    s = table(spark, sf_dir, "supplier").crossJoin(F.broadcast(n))
    return s.select("s_suppkey", F.concat_ws("|", catalog.ordered_names(ids, F.col("names"))).alias("names"))


_GREEDY_SQL = """
WITH slots AS (
  SELECT o_orderkey AS lineup_rank, l_linenumber AS slot, l_suppkey AS hero,
         CASE WHEN o_custkey % 3 = 0 THEN ' ' ELSE '' END || 'comp ' || (o_custkey % 40) AS line_name, l_partkey, l_quantity
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'
), one AS (SELECT *, trim(line_name) AS stored FROM slots QUALIFY row_number() OVER (PARTITION BY lineup_rank, hero ORDER BY slot) = 1),
fresh AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY hero, stored ORDER BY lineup_rank) = 1 OR stored <> line_name),
accepted AS (SELECT *, row_number() OVER (PARTITION BY hero ORDER BY lineup_rank) AS comp_rank FROM fresh QUALIFY comp_rank <= 3)
"""


def _greedy(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
    name = F.concat(F.when(F.col("o_custkey") % 3 == 0, " ").otherwise(""), F.lit("comp "), (F.col("o_custkey") % 40).cast("string"))
    slots = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("lineup_rank"), F.col("l_linenumber").alias("slot"), F.col("l_suppkey").alias("hero"), name.alias("line_name"),
        F.when(F.col("l_quantity") > 10, F.array(F.col("l_partkey").cast("string"))).otherwise(F.array().cast("array<string>")).alias("item_ids"),
        (F.col("l_partkey") % 3 > 0).alias("items_known"),
    )
    return etl.greedy_recommendations(slots)


@query(_GREEDY_SQL + "SELECT hero, comp_rank::INT AS comp_rank, stored AS name, lineup_rank FROM accepted")
def greedy_comps(spark, sf_dir):
    """Each hero's first three lineups of new names, in lineup order."""
    return _greedy(spark, sf_dir)[0]


@query(_GREEDY_SQL + """SELECT hero, l_partkey::VARCHAR AS items, lineup_rank FROM accepted WHERE l_quantity > 10 AND l_partkey % 3 > 0
QUALIFY row_number() OVER (PARTITION BY hero ORDER BY lineup_rank) = 1""")
def greedy_equipment(spark, sf_dir):
    return _greedy(spark, sf_dir)[1].select("hero", F.concat_ws(",", "item_ids").alias("items"), "lineup_rank")


@query("""SELECT n_nationkey, s.stat, coalesce(s.label, s.stat) AS label, s.value FROM (
  SELECT n_nationkey, unnest([{'stat': 'region', 'label': 'Region', 'value': n_regionkey::VARCHAR}, {'stat': 'length', 'label': NULL, 'value': length(n_name)::VARCHAR}]) AS s FROM nation)""")
def unpivot_stats(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    heroes = n.select(F.col("n_nationkey").alias("id"), F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("length"), F.length("n_name").cast("string")).alias("stats"))
    return selection.unpivot_stats(heroes, {"region": "Region"}).withColumnRenamed("id", "n_nationkey")


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority <> '1-URGENT', o_totalprice DESC, o_orderkey::VARCHAR)::INT AS place
FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def publication_order(spark, sf_dir):
    """Each feed's published lineups in order; ids are ordered as text."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderpriority") != "1-URGENT", F.desc("o_totalprice"), F.col("o_orderkey").cast("string"))
    return o.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"))


@query("""
WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN 'tomorrow' WHEN 2 THEN '2024-02-31' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS raw FROM events)
SELECT event_id, event_id % 4 = 0 AS is_day, event_id % 4 IN (0, 3) AS is_day_or_instant, event_id % 4 = 3 AS is_stamp FROM x""")
def strict_dates(spark, sf_dir):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, "tomorrow").when(k == 2, "2024-02-31").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    x = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return x.select("event_id", text.is_day(F.col("raw")).alias("is_day"), text.is_day_or_instant(F.col("raw")).alias("is_day_or_instant"), text.stamp(F.col("raw")).isNotNull().alias("is_stamp"))


# --- numbers, windows and shapes ----------------------------------------------

@query("""SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 7 + 0.5)::BIGINT AS half_up, least(20, trunc(l_quantity - 10))::INT AS score FROM lineitem WHERE l_quantity >= 10
UNION ALL SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 7 + 0.5)::BIGINT, 0 FROM lineitem WHERE l_quantity < 10""")
def rounded_scores(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.round_half_up(F.col("l_extendedprice") / 7).alias("half_up"), numbers.set_score(F.col("l_quantity") - 10).alias("score"))


@query("""SELECT p_partkey, floor(ln(p_size / 7.0::DOUBLE) / ln(1.13::DOUBLE) + 0.5)::INT AS bucket FROM part""")
def aspect_buckets(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", numbers.aspect_bucket(F.col("p_size") / F.lit(7.0)).alias("bucket"))


@query("""
WITH x AS (SELECT p_partkey, (p_partkey % 90 + 5)::INT AS span, p_size::INT AS win, 10 AS step FROM part)
SELECT p_partkey, CASE WHEN span <= win THEN '0' ELSE array_to_string(list_distinct_sorted, ',') END AS starts FROM (
  SELECT *, list_concat(list_filter(range(0, greatest(span - win, 0) + 1, step), lambda p: p < span - win), [span - win]) AS list_distinct_sorted FROM x)""")
def stride_positions(spark, sf_dir):
    at = numbers.stride_positions((F.col("p_partkey") % 90 + 5).cast("int"), F.col("p_size"), F.lit(10))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", at.cast("array<string>")).alias("starts"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber AS n, (l_partkey % 50)::DOUBLE AS x, (l_suppkey % 50)::DOUBLE AS y, l_quantity + 40 AS w, l_quantity + 40 AS h FROM lineitem),
p AS (SELECT a.l_orderkey, a.n AS a, b.n AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS s, a.w * a.h + b.w * b.h AS t
  FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.n < b.n)
SELECT l_orderkey, a, b, round(s / (t - s), 9) AS iou FROM p WHERE s / (t - s) >= 0.5""")
def box_overlaps(spark, sf_dir):
    """Boxes of one order (at most a few lines) that overlap by half."""
    li = table(spark, sf_dir, "lineitem")
    box = F.struct((F.col("l_partkey") % 50).cast("double").alias("x"), (F.col("l_suppkey") % 50).cast("double").alias("y"), (F.col("l_quantity") + 40).alias("width"), (F.col("l_quantity") + 40).alias("height"))
    b = li.select("l_orderkey", F.col("l_linenumber").alias("n"), box.alias("box"))
    pairs = b.select("l_orderkey", F.col("n").alias("a"), F.col("box").alias("p")).join(b.select("l_orderkey", F.col("n").alias("b"), F.col("box").alias("q")), "l_orderkey").where("a < b")
    return pairs.withColumn("iou", numbers.box_overlap(F.col("p"), F.col("q"))).where("iou >= 0.5").select("l_orderkey", "a", "b", F.round("iou", 9).alias("iou"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS total, sum(CAST(l_quantity AS BIGINT)) OVER w <= 100 AS within
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)""")
def running_budget(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("size"))
    return ordering.running_budget(li, "l_orderkey", "size", 100, "l_linenumber", "l_partkey", "l_suppkey", "size").select("l_orderkey", "l_linenumber", "total", "within")


@query("""
WITH g AS (SELECT (l_suppkey % 12)::INT AS r, (l_partkey % 15)::INT AS c, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY ALL)
SELECT a.r, a.c, CAST(sum(b.v) AS BIGINT) AS v FROM g a JOIN g b ON b.r <= a.r AND b.c <= a.c GROUP BY ALL""")
def prefix_sums(spark, sf_dir):
    """Two-dimensional prefix sums over a grid that is summed first (it has every cell)."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy((F.col("l_suppkey") % 12).cast("int").alias("r"), (F.col("l_partkey") % 15).cast("int").alias("c")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    return ordering.prefix_sums(g, "r", "c", ["v"])


@query("""
WITH v AS (SELECT user_id, event_id, value, coalesce(lead(value) OVER w, first_value(value) OVER w) AS next_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, next_value FROM v""")
def wraparound(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts")
    return ordering.next_with_wraparound(e, "user_id", "value", "ts", "event_id").select("event_id", "next_value")


@query("""
WITH r AS (SELECT *, row_number() OVER w AS rn, lead(value) OVER w AS runner_up FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id))
SELECT user_id, event_id, value, runner_up, value - runner_up AS margin FROM r WHERE rn = 1""")
def runner_up_margin(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return ordering.best_and_runner_up(e, "user_id", "value", "event_id")


@query("""SELECT user_id, value, event_id FROM (SELECT user_id, floor(value)::BIGINT AS value, event_id FROM events)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1""")
def best_first_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.floor("value").alias("value"), "event_id")
    return ordering.best_first_wins(e, "user_id", "value", "event_id")


# --- vectors and text matching ---------------------------------------------------

_HASH_SQL = """
WITH s AS (SELECT vec_id, label, embedding[2:64] AS v, list_sort(embedding[2:64])[32] AS m FROM embeddings),
h AS (SELECT vec_id, label, CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN v[i] > m THEN (1::BIGINT << (i - 1)::INT) ELSE 0 END)) AS BIGINT) AS hash FROM s)
"""


@query(_HASH_SQL + "SELECT vec_id, hash FROM h")
def median_hash(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", vision.median_hash(F.col("embedding")).alias("hash"))


@query(_HASH_SQL + """SELECT q.vec_id, h.vec_id AS near, CAST(bit_count(xor(q.hash, h.hash)) AS INT) AS distance FROM h q JOIN h ON q.label = h.label AND q.vec_id <> h.vec_id
WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.hash, h.hash)), h.vec_id) <= 3""")
def hamming_neighbours(spark, sf_dir):
    """The three nearest hashes of the same label for every twentieth vector, against all vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", vision.median_hash(F.col("embedding")).alias("hash"))
    q = e.where("vec_id % 20 = 0").select("vec_id", "label", F.col("hash").alias("q_hash"))
    rows = e.select(F.col("vec_id").alias("near"), "label", "hash")
    return matching.nearest_hashes(q, rows, 3, "near", "vec_id", ["label"]).select("vec_id", "near", "distance")


@query(r"""
WITH lines AS (SELECT doc_id, regexp_replace(lower(unnest(string_split(text, chr(10)))), '[\s\p{P}\p{S}]+', '', 'g') AS line FROM documents WHERE lang = 'en'),
names AS (SELECT item_id, lower(regexp_extract(text, '[A-Za-z]{9,}')) AS name FROM benchmark),
hits AS (SELECT DISTINCT doc_id, item_id FROM lines JOIN names ON name <> '' AND contains(line, name))
SELECT doc_id, min(item_id) AS item_id FROM hits GROUP BY doc_id HAVING count(*) = 1""")
def named_lines(spark, sf_dir):
    """English documents in whose lines exactly one name stands; the language is part of its SQL. ``named_lines_all`` reads every document."""
    return _named(table(spark, sf_dir, "documents").where("lang = 'en'"), table(spark, sf_dir, "benchmark"))


@query(r"""
WITH lines AS (SELECT doc_id, regexp_replace(lower(unnest(string_split(text, chr(10)))), '[\s\p{P}\p{S}]+', '', 'g') AS line FROM documents),
names AS (SELECT item_id, lower(regexp_extract(text, '[A-Za-z]{9,}')) AS name FROM benchmark),
hits AS (SELECT DISTINCT doc_id, item_id FROM lines JOIN names ON name <> '' AND contains(line, name))
SELECT doc_id, min(item_id) AS item_id FROM hits GROUP BY doc_id HAVING count(*) = 1""")
def named_lines_all(spark, sf_dir):
    """Documents of any language in whose lines exactly one name stands."""
    return _named(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _named(documents, benchmark):
    """A name is one long word of a benchmark item; all names are looked for in one walk along each text."""
    names = benchmark.select(F.col("item_id").alias("name_id"), F.lower(F.regexp_extract("text", "[A-Za-z]{9,}", 0)).alias("name"))
    hits = matching.names_in_lines(documents.select("doc_id", text.ocr_lines(F.col("text")).alias("text")), names).distinct()
    return hits.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("name_id").alias("item_id")).where("n = 1").drop("n")


@query("""
WITH b AS (SELECT event_id % 400 AS c, user_id AS hero, max(value) / 100 AS score FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM b WINDOW w AS (PARTITION BY c ORDER BY score DESC, hero DESC))
SELECT c, CASE WHEN score >= 0.88 AND (second IS NULL OR score - second >= 0.045) THEN 'match' ELSE 'uncertain' END AS status, hero AS best FROM r WHERE rn = 1""")
def decisions(spark, sf_dir):
    """Threshold and margin over each case's best scores."""
    e = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 400).alias("c"), F.col("user_id").alias("heroId")).agg((F.max("value") / 100).alias("score"))
    done = vision.decide(e.withColumn("method", F.lit("phash")), ["c"], floor=-1.0)
    return done.select("c", "status", F.col("matches")[0]["heroId"].alias("best"))


@query("""
WITH b AS (SELECT event_id % 400 AS c, user_id AS hero, round(max(value)) / 100 AS score, min(event_id) AS seen FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second, lead(hero) OVER w AS next FROM b WINDOW w AS (PARTITION BY c ORDER BY score DESC, seen))
SELECT c, CASE WHEN score >= 0.9 AND (second IS NULL OR score - second >= 0.02) THEN 'match' ELSE 'uncertain' END AS status, hero AS best,
  CASE WHEN second >= 0.5 THEN next END AS next FROM r WHERE rn = 1 AND score >= 0.5
UNION ALL SELECT c, 'uncertain', NULL, NULL FROM r WHERE rn = 1 AND score < 0.5""")
def decisions_in_order(spark, sf_dir):
    """Threshold and margin over each case's best scores, equal ones in the order they were seen, with thresholds of one's own."""
    e = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 400).alias("c"), F.col("user_id").alias("heroId"))
    best = e.agg((F.round(F.max("value")) / 100).alias("score"), F.min("event_id").alias("ordinal")).withColumn("method", F.lit("phash"))
    done = vision.decide(best, ["c"], floor=0.5, thresholds=(0.9, 0.9, 0.9), margins=(0.02, 0.02))
    return done.select("c", "status", F.get("matches", F.lit(0))["heroId"].alias("best"), F.get("matches", F.lit(1))["heroId"].alias("next"))


_LINEUP_SQL = """
WITH l AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'S' WHEN '2-HIGH' THEN 'A' ELSE 'B' END AS quality, CAST(floor(o_totalprice) AS BIGINT) AS "order" FROM orders),
m AS (SELECT l_orderkey AS id, l_suppkey AS hero, l_linenumber = 1 AS carry FROM lineitem)"""


def _lineups(spark, sf_dir):
    """Orders as graded lineups, their lines as members: the supplier is the hero, the first line the carry."""
    grade = F.when(F.col("o_orderpriority") == "1-URGENT", "S").when(F.col("o_orderpriority") == "2-HIGH", "A").otherwise("B")
    member = F.struct(
        F.col("l_suppkey").cast("string").alias("heroId"), F.concat(F.lit("name "), F.col("l_suppkey").cast("string")).alias("name"), F.lit("hero").alias("kind"), (F.col("l_linenumber") == 1).alias("isCarry")
    )
    members = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(member).alias("members"))  # the lines of one order
    orders = table(spark, sf_dir, "orders").join(members, "o_orderkey")
    return orders.select(F.col("o_orderkey").alias("id"), grade.alias("quality"), F.floor("o_totalprice").alias("sortOrder"), F.col("o_orderkey").alias("ordinal"), "members")


@query(_LINEUP_SQL + """
SELECT l.id, quality, bool_or(carry) AS carry FROM l JOIN m ON m.id = l.id AND hero = 7 WHERE quality = 'S' GROUP BY ALL""")
def lineups_of_a_hero(spark, sf_dir):
    """The lineups of one hero and grade, with whether the hero carries them."""
    return selection.select_lineups(_lineups(spark, sf_dir), "7", "name 7", quality="S").select("id", "quality", "carry")


@query(_LINEUP_SQL + """
SELECT s_suppkey::VARCHAR AS id, count(DISTINCT l.id) AS lineups FROM supplier LEFT JOIN m ON hero = s_suppkey LEFT JOIN l ON l.id = m.id AND quality IN ('S', 'A') GROUP BY s_suppkey""")
def lineups_of_each_hero(spark, sf_dir):
    """How many graded lineups each hero is in, zero included."""
    heroes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("name "), F.col("s_suppkey").cast("string")).alias("name"))
    return selection.lineups_per_hero(heroes, _lineups(spark, sf_dir)).select("id", "lineups")


@query("""
SELECT o_orderkey::VARCHAR AS id, row_number() OVER (ORDER BY o_orderpriority <> '1-URGENT', o_custkey DESC, o_orderkey::VARCHAR) AS place
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O'""")
def published_feed(spark, sf_dir):
    """A feed's published lineups, numbered in feed order."""
    o = table(spark, sf_dir, "orders")
    feed = o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", "S").when(F.col("o_orderpriority") == "2-HIGH", "A").otherwise("B").alias("quality"),
        F.col("o_custkey").cast("string").alias("sortID"), F.when(F.col("o_orderstatus") == "O", etl.PUBLISHED_STATUS).otherwise("0").alias("status"),
        F.lit(etl.PUBLISHED_MODE).alias("mode"), F.lit("e").alias("simulator_edition"), F.lit("s").alias("simulator_season"),
    )
    return ordering.numbered(etl.published(feed, "e", "s"), etl.feed_keys()).select("id", "place")


@query("""SELECT 'line ' || l_orderkey || ' ' || l_partkey AS path, 'key occurs more than once' AS reason FROM (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'customer ' || c_nationkey, 'key occurs more than once' FROM (SELECT c_nationkey FROM customer GROUP BY ALL HAVING count(*) > 1)""")
def repeated_keys(spark, sf_dir):
    """One violation for each repeated key."""
    li, c = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer")
    named = lambda start, *keys: F.concat_ws(" ", F.lit(start), *[F.col(k).cast("string") for k in keys])
    return validation.all_of([
        validation.duplicates(li, ["l_orderkey", "l_partkey"], named("line", "l_orderkey", "l_partkey")),
        validation.duplicates(c, ["c_nationkey"], named("customer", "c_nationkey")),
    ])


@query("""
SELECT user_id AS "selectedHeroId", event_id % 150 AS "heroId", event_id, t.c_name AS right_name, w.c_name AS chosen_name
FROM events LEFT JOIN customer t ON t.c_custkey = event_id % 150 LEFT JOIN customer w ON w.c_custkey = user_id WHERE event_id % 150 <> user_id""")
def wrong_choices(spark, sf_dir):
    """Wrong answers with the names of the right and of the chosen one."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 150).alias("heroId"), F.col("user_id").alias("selectedHeroId"))
    heroes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return catalog.wrong_answers(e.withColumn("correct", F.col("heroId") == F.col("selectedHeroId")), heroes).drop("correct")


@query("""
SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, user_id AS player, count(*) AS answered, count(*) FILTER (value > 50) AS correct,
  CAST(floor(count(*) FILTER (value > 50) * 100.0::DOUBLE / count(*) + 0.5) AS BIGINT) AS rate FROM events GROUP BY ALL""")
def live_scores(spark, sf_dir):
    """The streaming aggregation, run over the whole table as one batch."""
    e = table(spark, sf_dir, "events").select("ts", F.col("user_id").alias("player"), (F.col("value") > 50).alias("correct"))
    return history_stream.live_scores(e)


@query("""
WITH RECURSIVE e AS (
  SELECT user_id, epoch_us(ts) AS moment, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'shown' WHEN 'purchase' THEN 'next' ELSE 'answer' END AS kind,
    CASE WHEN value > 90 THEN event_id % 3 END AS named, value > 15 AS is_right, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, max(epoch_us(ts)) OVER () AS now
  FROM events),
s AS (
  SELECT DISTINCT user_id, 0::BIGINT AS rn, 0 AS run, false AS playing, 0 AS q, false AS shown, false AS answered, 0 AS answers, 0 AS rights, 0::BIGINT AS started, 0::BIGINT AS seen,
    NULL::VARCHAR AS status, 0 AS e_run, 0 AS e_answers, 0 AS e_rights, 0::BIGINT AS e_started, 0::BIGINT AS ended FROM e
  UNION ALL
  SELECT user_id, rn, run + begins::INT, begins OR (live AND NOT done), CASE WHEN begins THEN 0 WHEN moves AND NOT done THEN q + 1 ELSE q END,
    NOT begins AND NOT moves AND (shown OR (fits AND kind = 'shown')), NOT begins AND NOT moves AND (answered OR counts),
    CASE WHEN begins THEN 0 ELSE answers + counts::INT END, CASE WHEN begins THEN 0 ELSE rights + (counts AND is_right)::INT END,
    CASE WHEN begins THEN moment ELSE started END, CASE WHEN begins OR live THEN moment ELSE seen END,
    CASE WHEN stale THEN 'expired' WHEN done THEN 'complete' END, run, answers + counts::INT, rights + (counts AND is_right)::INT, started, CASE WHEN stale THEN seen + 172800000000 ELSE moment END
  FROM (
    SELECT *, moves AND q = 2 AS done FROM (
      SELECT *, fits AND ((kind = 'next' AND answered) OR (counts AND is_right)) AS moves FROM (
        SELECT *, fits AND kind = 'answer' AND shown AND NOT answered AS counts FROM (
          SELECT *, live AND (named IS NULL OR named = q) AS fits, NOT live AND kind = 'start' AS begins FROM (
            SELECT *, playing AND NOT stale AS live FROM (
              SELECT s.* EXCLUDE (rn, status, e_run, e_answers, e_rights, e_started, ended), e.* EXCLUDE (user_id), playing AND e.moment - seen > 172800000000 AS stale
              FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1))))))),
last AS (SELECT *, (SELECT max(now) FROM e) AS now FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1),
ended AS (
  SELECT user_id, e_run AS run, status, e_answers AS answered, e_rights AS correct, e_started AS started, ended FROM s WHERE status IS NOT NULL
  UNION ALL SELECT user_id, run, 'expired', answers, rights, started, seen + 172800000000 FROM last WHERE playing AND now - seen > 172800000000)
SELECT user_id::VARCHAR AS player, run, status, answered, correct, correct * 5 AS score, epoch_us(make_timestamp(started)) AS started_us, epoch_us(make_timestamp(ended)) AS ended_us FROM ended""")
def quiz_runs_of_players(spark, sf_dir):
    """Runs of three questions: the state machine of the stream, over the whole table of events."""
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "start", "view", "shown", "click", "answer", "error", "answer", "purchase", "next")]), F.col("event_type"))
    e = table(spark, sf_dir, "events").select(
        "ts", F.col("user_id").alias("player"), F.col("event_id").alias("ordinal"), kind.alias("kind"), F.when(F.col("value") > 90, F.col("event_id") % 3).alias("question"), (F.col("value") > 15).alias("correct")
    )
    runs = quiz_runs.runs_of(e, questions=3, idle_seconds=172_800)
    return runs.select("player", "run", "status", "answered", "correct", "score", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, floor((l_partkey % 300) * (960 / 480.0::DOUBLE) + 0.5)::INT AS x, floor((l_suppkey % 200) * (540 / 360.0::DOUBLE) + 0.5)::INT AS y,
  floor(l_quantity * (960 / 480.0::DOUBLE) + 0.5)::INT AS width, floor(l_quantity * (540 / 360.0::DOUBLE) + 0.5)::INT AS height FROM lineitem""")
def scaled_boxes(spark, sf_dir):
    box = F.struct((F.col("l_partkey") % 300).alias("x"), (F.col("l_suppkey") % 200).alias("y"), F.col("l_quantity").alias("width"), F.col("l_quantity").alias("height"))
    to = vision.scaled_box(box, F.lit(480.0), F.lit(960), F.lit(360.0), F.lit(540))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", to.alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", "b.*")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, "row", "column", ("column" - 1) * 40.0::DOUBLE + CASE WHEN "row" % 2 = 0 THEN 20 ELSE 0 END AS "left", ("row" - 1) * 40.0::DOUBLE AS top
FROM (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 4 + 1)::INT AS "row", (l_suppkey % 7 + 1)::INT AS "column" FROM lineitem)""")
def cell_offsets(spark, sf_dir):
    """The places of order lines that stand on cells of the board; even rows are shifted."""
    cell = ((F.col("l_partkey") % 4 + 1).cast("int").alias("row"), (F.col("l_suppkey") % 7 + 1).cast("int").alias("column"))
    return selection.cell_offsets(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *cell), 40.0)


@query("""
WITH first_name AS (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_nationkey)
SELECT c_custkey, coalesce(a.s_suppkey, f.s_suppkey) AS hero FROM customer LEFT JOIN supplier a ON c_custkey = a.s_suppkey LEFT JOIN first_name f ON f.s_nationkey = c_nationkey""")
def by_id_then_name(spark, sf_dir):
    """A lookup by key, else by name, the first of that name."""
    heroes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("name"), F.col("s_suppkey").alias("ordinal"))
    found = catalog.by_id_then_name(table(spark, sf_dir, "customer"), heroes, "c_custkey", "c_nationkey")
    return found.select("c_custkey", F.col("hero.id").alias("hero"))


def _formations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as formations of their lines; heavy lines carry, returned lines have an item."""
    li = table(spark, sf_dir, "lineitem")
    member = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") > 40).alias("isCarry"),
        F.when(F.col("l_returnflag") == "R", F.array("l_partkey")).otherwise(F.array().cast("array<bigint>")).alias("items"),
    )
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(member)).alias("members"))  # a few lines an order


@query("""
SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R')::INT AS equipped, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) FILTER (l_quantity > 40) AS carry FROM lineitem GROUP BY l_orderkey""")
def carries_and_equipment(spark, sf_dir):
    f = _formations(spark, sf_dir)
    return f.select("l_orderkey", F.size(selection.equipped(F.col("members"))).alias("equipped"), selection.first_carry(F.col("members"))["l_partkey"].alias("carry"))


@query("""
SELECT s_suppkey, section, label, text FROM (
  SELECT s_suppkey, unnest([{'section': 'early', 'label': 'Early', 'text': s_name}, {'section': 'late', 'label': 'Late', 'text': CASE WHEN s_acctbal < 0 THEN '  ' ELSE s_acctbal::INT::VARCHAR END}], recursive := true) FROM supplier)
WHERE trim(text) <> ''""")
def guide_sections(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    late = F.when(F.col("s_acctbal") < 0, "  ").otherwise(F.rint("s_acctbal").cast("int").cast("string"))
    rows = s.select(F.col("s_suppkey").alias("id"), F.struct(F.col("s_name").alias("early"), late.alias("late")).alias("guide"))
    return selection.guide_sections(rows, {"early": "Early", "late": "Late"}).withColumnRenamed("id", "s_suppkey")


@query("""SELECT l_orderkey, min(l_partkey) AS x, min(l_suppkey) AS y, max(l_partkey) - min(l_partkey) AS width, max(l_suppkey) - min(l_suppkey) AS height FROM lineitem GROUP BY l_orderkey""")
def bounding_boxes(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"))
    return vision.bounding_box(points, ["l_orderkey"])


@query("""SELECT user_id, count(*) FILTER (value > 40) AS inliers, count(*) FILTER (value > 40) >= 12 AND count(*) FILTER (value > 40) / count(*) >= 0.55 AS accepted FROM events GROUP BY user_id""")
def inlier_gate(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 40).alias("inliers"), F.count("*").alias("n"))
    return n.select("user_id", "inliers", vision.enough_inliers(F.col("inliers"), F.col("n")).alias("accepted"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus, o_orderpriority) IN (SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders))""")
def gated_rows(spark, sf_dir):
    """Rows pass only if a one-row state agrees with them."""
    o = table(spark, sf_dir, "orders")
    meta = o.agg(F.min_by(F.struct("o_orderstatus", "o_orderpriority"), "o_orderkey").alias("m")).select("m.*")
    return catalog.gated(o, meta, ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "o_totalprice")


@query("""
WITH r AS (SELECT ps.c_custkey // 3 || '/' || ps.c_custkey % 3 AS key FROM customer ps),
v AS (SELECT s_suppkey AS h, unnest(range(2)) AS k FROM supplier)
SELECT key FROM r WHERE key IN (SELECT h || '/' || k FROM v)""")
def catalogue_references(spark, sf_dir):
    """Stored references that a catalogue's variants name."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    stored = c.select(F.concat_ws("/", F.floor(F.col("c_custkey") / 3).cast("string"), (F.col("c_custkey") % 3).cast("string")).alias("key"))
    variants = s.select(F.col("s_suppkey").cast("string").alias("heroId"), F.explode(F.array(F.lit("0"), F.lit("1"))).alias("variantId"))
    return catalog.of_catalogue(stored, variants)


@query("""SELECT (SELECT count(*) FROM supplier) AS heroes, (SELECT count(*) FROM customer) AS "references", (SELECT max(n_nationkey) FROM nation) AS pack_images, true AS present""")
def library_counts(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.lit("s").alias("seasonId"), F.lit("p").alias("patch"), F.col("n_nationkey").alias("referenceCount"))
    return catalog.library_counts(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer"), n)


@query("""SELECT p_partkey, left(p_name, 1) AS initial, lower(string_split(p_type, ' ')[-1]) AS extension, CASE WHEN starts_with(p_brand, 'Brand#1') THEN substr(p_brand, 8) ELSE p_brand END AS brand,
  p_brand || '/' || p_size AS key, strftime(make_timestamp(p_partkey * 3600000000), '%-m/%-d %H:%M') AS shown FROM part""")
def name_pieces(spark, sf_dir):
    """First letters, extensions, ids without their prefix, joined keys and short dates."""
    p = table(spark, sf_dir, "part").withColumn("size", F.col("p_size").cast("string"))
    return p.select(
        "p_partkey", text.initial(F.col("p_name")).alias("initial"), text.extension(F.replace(F.col("p_type"), F.lit(" "), F.lit("."))).alias("extension"),
        text.without_prefix(F.col("p_brand"), "Brand#1").alias("brand"), text.composite_key("p_brand", "size").alias("key"), text.short_date(F.timestamp_seconds(F.col("p_partkey") * 3600)).alias("shown"),
    )


@query("""SELECT p_partkey, list_filter(string_split(p_type, ' '), lambda x: x <> '')[1] AS first_part, len(list_filter(string_split(p_name || ',,' || p_brand || ',', ','), lambda x: x <> ''))::INT AS parts FROM part""")
def split_lists(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.get(text.listed(F.col("p_type"), " "), F.lit(0)).alias("first_part"), F.size(text.listed(F.concat("p_name", F.lit(",,"), "p_brand", F.lit(",")))).alias("parts"))


@query("""
WITH p AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS x, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS y FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, abs(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * y[i % len(x) + 1] - x[i % len(x) + 1] * y[i]))) / 2.0::DOUBLE AS area FROM p""")
def polygon_areas(spark, sf_dir):
    """Areas of the outlines that the lines of an order draw."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y")))).alias("points"))
    return li.select("l_orderkey", numbers.polygon_area(F.col("points")).alias("area"))  # a few lines an order


@query("""
WITH f AS (SELECT event_id, ['89504E470D0A1A0A', 'FFD8FF', '524946460000000057454250', '47494638'][event_id % 4 + 1] AS head, ['png', 'JPG', 'webp', 'jpeg', 'gif'][event_id % 5 + 1] AS kind FROM events)
SELECT event_id, CASE WHEN head[1:4] = '8950' AND kind = 'png' THEN 'image/png' WHEN head = 'FFD8FF' AND kind IN ('JPG', 'jpeg') THEN 'image/jpeg' WHEN head[1:4] = '5249' AND kind = 'webp' THEN 'image/webp' END AS mime FROM f""")
def image_types(spark, sf_dir):
    """The type that a file's first bytes and its name agree on."""
    pick = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % by).cast("int"))
    content = F.unhex(pick(["89504E470D0A1A0A", "FFD8FF", "524946460000000057454250", "47494638"], 4))
    path = F.concat(F.lit("a.b/c."), pick(["png", "JPG", "webp", "jpeg", "gif"], 5))
    return table(spark, sf_dir, "events").select("event_id", text.image_mime(content, path).alias("mime"))


@query(_HASH_SQL + """,
d AS (SELECT vec_id, label, [hash, hash // 3, hash // 7, hash // 11] AS w, (vec_id * 2654435761) & 1048575 AS noise FROM h),
p AS (SELECT q.label, q.vec_id AS q, t.vec_id AS t, list_sum(list_transform(range(1, 5), lambda i: bit_count(xor(xor(q.w[i], q.noise), t.w[i]))))::INT AS distance FROM d q JOIN d t USING (label) WHERE q.vec_id % 20 = 0),
two AS (SELECT *, lead(distance) OVER w AS second, row_number() OVER w AS rn FROM p WINDOW w AS (PARTITION BY label, q ORDER BY distance, t)),
good AS (SELECT label, q, t, distance FROM two WHERE rn = 1 AND distance <= 70 AND distance < 0.75 * second)
SELECT label AS "group", q, t, distance FROM good QUALIFY row_number() OVER (PARTITION BY label, t ORDER BY q) = 1""")
def descriptor_matches(spark, sf_dir):
    """Every twentieth vector's descriptor with some bits changed, against the descriptors of its label."""
    h = table(spark, sf_dir, "embeddings").select(F.col("label").alias("group"), "vec_id", vision.median_hash(F.col("embedding")).alias("hash"))
    words = F.array(F.col("hash"), F.expr("hash div 3"), F.expr("hash div 7"), F.expr("hash div 11"))
    noise = (F.col("vec_id") * 2654435761).bitwiseAND(1048575)
    asked = h.where("vec_id % 20 = 0").select("group", F.col("vec_id").alias("q"), F.transform(words, lambda w: w.bitwiseXOR(noise)).alias("q_words"))
    train = h.select("group", F.col("vec_id").alias("t"), words.alias("t_words"))
    return matching.nearest_descriptors(asked, train)


@query(_LINEUP_SQL + """
SELECT l.id, row_number() OVER (ORDER BY bool_or(carry) DESC, quality = 'A', l."order" DESC, l.id) AS place FROM l JOIN m ON m.id = l.id AND hero = 7 WHERE quality IN ('S', 'A') GROUP BY l.id, quality, l."order" """)
def lineups_in_order(spark, sf_dir):
    """The graded lineups of one hero, numbered in the order in which they are shown."""
    chosen = selection.select_lineups(_lineups(spark, sf_dir), "7", "name 7")
    return ordering.numbered(chosen, [~F.col("carry"), F.col("quality") == "A", -F.col("sortOrder"), F.col("ordinal")]).select("id", "place")


@query()
def question_set(spark, sf_dir):
    """Twenty questions; the order is a function of the seed, so it is tested by its properties."""
    p = table(spark, sf_dir, "part")
    heroes = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.array(F.struct(F.lit("card").alias("id"), F.lit("card").alias("kind"))).alias("variants"), F.col("p_partkey").alias("ordinal"))
    images = heroes.select(F.col("id").alias("heroId"), F.lit("card").alias("variantId"), F.lit(b"x").cast("binary").alias("content"), F.col("ordinal").alias("imageOrdinal"))
    return quiz.option_letters(quiz.questions(heroes, images, seed=7))

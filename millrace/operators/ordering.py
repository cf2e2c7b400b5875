"""Order-dependent operators on an explicit ordinal: first, last, running, recent, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _names(columns: list[str] | str) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def first_per_key(frame: DataFrame, keys: list[str] | str, *order: Column | str) -> DataFrame:
    """The first row of each key. The window keeps one row a task and key before it shuffles."""
    w = Window.partitionBy(*_names(keys)).orderBy(*order)
    return frame.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_per_key(frame: DataFrame, keys: list[str] | str, ordinal: str) -> DataFrame:
    """The row of each key with the greatest ordinal."""
    return first_per_key(frame, keys, F.desc(ordinal))


def top_per_key(frame: DataFrame, keys: list[str] | str, count: int, *order: Column | str, into: str = "rank") -> DataFrame:
    w = Window.partitionBy(*_names(keys)).orderBy(*order)
    return frame.withColumn(into, F.row_number().over(w)).where(F.col(into) <= count)


def recent(frame: DataFrame, keys: list[str] | str, count: int, *order: Column | str) -> DataFrame:
    """The last rows of each key with their ordinal among all of the key's rows."""
    w = Window.partitionBy(*_names(keys)).orderBy(*order)
    total = F.count("*").over(Window.partitionBy(*_names(keys)))
    return frame.withColumn("ordinal", F.row_number().over(w)).withColumn("_n", total).where(F.col("ordinal") > F.col("_n") - count).drop("_n")


def running_rate(frame: DataFrame, keys: list[str] | str, hit: Column, *order: Column | str) -> DataFrame:
    """Hits so far, rows so far and the rate in whole per cent, halves up."""
    w = Window.partitionBy(*_names(keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        frame.withColumn("hits", F.sum(hit.cast("int")).over(w))
        .withColumn("seen", F.count("*").over(w))
        .withColumn("rate", F.floor(F.col("hits") * 100.0 / F.col("seen") + 0.5))
    )


def adjacent_repeats(frame: DataFrame, keys: list[str] | str, value: str, *order: Column | str) -> DataFrame:
    """Rows whose value equals the one before."""
    w = Window.partitionBy(*_names(keys)).orderBy(*order)
    return frame.withColumn("_before", F.lag(value).over(w)).where(F.col("_before") == F.col(value)).drop("_before")


def best_and_runner_up(frame: DataFrame, keys: list[str] | str, score: str, *ties: Column | str) -> DataFrame:
    """The best row of each key with the runner-up's score and the margin (null: no runner-up)."""
    w = Window.partitionBy(*_names(keys)).orderBy(F.desc(score), *ties)
    return (
        frame.withColumn("_rn", F.row_number().over(w))
        .withColumn("runner_up", F.lead(score).over(w))
        .where("_rn = 1")
        .withColumn("margin", F.col(score) - F.col("runner_up"))
        .drop("_rn")
    )


def best_first_wins(frame: DataFrame, keys: list[str] | str, score: str, ordinal: str, *carry: str) -> DataFrame:
    """The best score of each key; of equal ones the row that came first. ``max_by`` alone would keep any."""
    best = F.max_by(F.struct(score, ordinal, *carry), F.struct(F.col(score), -F.col(ordinal)))
    return frame.groupBy(*_names(keys)).agg(best.alias("_best")).select(*_names(keys), "_best.*")


#: Ranges that a global order is cut into, and rows of a sample that each is cut by.
RANGES = 64
SAMPLE_A_RANGE = 50


def _in_ranges(frame: DataFrame, order: list[Column], ranges: int) -> DataFrame:
    """Add ``_range``: nearly equal shares of the rows, numbered in order. The cuts are taken from a sample, once, so
    that every reader of the frame sees the same ranges; any cuts are right, good ones are even."""
    keyed = frame.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    wanted, rows = ranges * SAMPLE_A_RANGE, frame.count()
    some = keyed.select("_key") if rows <= wanted else keyed.select("_key").sample(wanted / rows, seed=7)
    drawn = some.orderBy("_key").collect()  # about ``wanted`` keys, however many rows there are
    cuts = [r["_key"] for r in drawn[SAMPLE_A_RANGE::SAMPLE_A_RANGE]]
    held = frame.sparkSession.createDataFrame([(cuts,)], T.StructType([T.StructField("_cuts", T.ArrayType(keyed.schema["_key"].dataType))]))
    return keyed.crossJoin(F.broadcast(held)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col("_key")))).drop("_cuts")


def running_total(frame: DataFrame, value: Column, order: list[Column], keys: list[str] | str = (), into: str = "total", ranges: int = RANGES) -> DataFrame:
    """Add the sum of ``value`` over a row and all before it, of equal ``keys``, in ascending ``order``.

    A scan of two levels: ranges of rows are summed beside each other, then each
    range begins with the sum of those before it. No task gets more than a range,
    however many rows a key has. ``order`` must tell any two rows of a key apart
    for a defined result; nulls come first, and null keys are keys. A null value
    adds nothing; an empty table stays empty.
    """
    keys = _names(keys)
    cut = _in_ranges(frame, [F.col(k) for k in keys] + order, ranges).withColumn("_value", value)
    within = Window.partitionBy("_range", *keys).orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    sums = cut.groupBy(*keys, "_range").agg(F.coalesce(F.sum("_value"), F.lit(0)).alias("sum"))
    listed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_range", "sum"))).alias("all"))  # at most ``ranges`` entries
    before = F.transform("all", lambda x: F.struct(x["_range"].alias("range"), F.aggregate(F.filter("all", lambda y: y["_range"] < x["_range"]), F.lit(0).cast(sums.schema["sum"].dataType), lambda acc, y: acc + y["sum"]).alias("before")))
    offsets = listed.withColumn("_o", F.explode(before)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_o.range").alias("_r"), F.col("_o.before").alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    summed = cut.withColumn("_local", F.coalesce(F.sum("_value").over(within), F.lit(0))).join(offsets, same)
    return summed.withColumn(into, F.col("_local") + F.col("_before")).select(*frame.columns, into)


def numbered(frame: DataFrame, order: list[Column], keys: list[str] | str = (), into: str = "place") -> DataFrame:
    """Add each row's number, from 1, in ascending ``order``: a ``running_total`` of ones."""
    return running_total(frame, F.lit(1).cast("long"), order, keys, into)


def chart_points(frame: DataFrame, rate: str, *order: Column | str, last: int = 10) -> DataFrame:
    """x in 0..1 by place among the last sets (a single one is centred), y by rate. A report of ``last`` rows."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    tail = frame.orderBy(*[o.desc() for o in order]).limit(last)
    listed = tail.agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("key"), F.struct(*frame.columns).alias("row")))).alias("all"))
    n = F.size("all")
    points = listed.select(n.alias("n"), F.posexplode("all").alias("at", "p")).select("n", "at", "p.row.*")
    return points.withColumn("x", F.when(F.col("n") == 1, 0.5).otherwise(F.col("at") / (F.col("n") - 1))).withColumn("y", 1 - F.col(rate) / 100).drop("n", "at")


def running_budget(frame: DataFrame, keys: list[str] | str, size: str, budget: int, *order: Column | str) -> DataFrame:
    """Running total of sizes and whether it is still within the budget."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    return running_total(frame, F.col(size), order, keys).withColumn("within", F.col("total") <= budget)


def prefix_sums(frame: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Two-dimensional prefix sums: along each row, then down each column."""
    along = Window.partitionBy(row).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(column).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    for v in values:
        frame = frame.withColumn(v, F.sum(v).over(along))
    for v in values:
        frame = frame.withColumn(v, F.sum(v).over(down))
    return frame


def next_with_wraparound(frame: DataFrame, keys: list[str] | str, value: str, *order: Column | str) -> DataFrame:
    """The next value, the last row's being the first."""
    w = Window.partitionBy(*_names(keys)).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return frame.withColumn("next_value", F.coalesce(F.lead(value).over(w), F.first(value).over(whole)))


def local_order(ids: str) -> Column:
    """Sort key in dictionary order of letters, upper and lower case side by side."""
    return F.collate(F.col(ids), "UNICODE")

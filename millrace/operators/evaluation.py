"""Outcomes of labelled recognition runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import fixed_decimals

#: The categories that always have a row.
CATEGORIES = ["game", "splash", "unknown"]


def nearest_rank(value: str, share: float) -> Column:
    """The value at rank ceil(share * n), counted from 1; no interpolation."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")


#: Steps of the grid that brackets a rank, and what the grid's sketch holds for each group.
GRID_STEPS, GRID_ENTRIES = 2000, 10_000
#: Rows of a group beyond which a second grid is laid inside the first bracket.
ONE_GRID_ROWS = 50_000_000


def _bracketed(frame: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, share, asked, lo, hi): values of the column ``v`` between which the rank must be, by a sketch of fixed size."""
    grid = F.percentile_approx("v", [i / GRID_STEPS for i in range(GRID_STEPS + 1)], GRID_ENTRIES)
    made = frame.groupBy(*keys, "share").agg(grid.alias("g"), F.count("*").alias("inside"), F.min("v").alias("least"), F.max("v").alias("most"), F.first("rank").alias("rank"), F.first("asked").alias("asked"))
    at = F.col("rank") * GRID_STEPS / F.col("inside")
    return made.select(
        *keys, "share", "asked",
        F.when(at < 3, F.col("least")).otherwise(F.get("g", F.floor(at).cast("int") - 2)).alias("lo"),
        F.when(at > GRID_STEPS - 3, F.col("most")).otherwise(F.get("g", F.ceil(at).cast("int") + 2)).alias("hi"),
    )


def nearest_ranks(frame: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each share): the value at rank ceil(share * n) of each group, counted from 1.

    Exact, in three scans (four for groups of over ``ONE_GRID_ROWS`` rows), with
    fixed memory a group: groups are counted, a sketch brackets each rank, then
    only the different values inside the bracket are counted and walked. Rows with
    a null value are left out; a group without values has no row.
    """
    named = keys
    keys = [f"_k{i}" for i in range(len(named))]  # whatever the groups' columns are called
    rows = frame.select(*[F.col(k).alias(a) for k, a in zip(named, keys, strict=True)], F.col(value).alias("v")).where("v IS NOT NULL")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("share"), F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n"))).cast("long").alias("rank")) for name, share in shares.items()]))
    ranks = sizes.select(*keys, wanted.alias("w")).select(*keys, "w.*").withColumn("asked", F.col("rank"))
    largest = sizes.agg(F.max("n")).head()[0] or 0
    bracket = _bracketed(_beside(rows, ranks, keys), keys)
    if largest > ONE_GRID_ROWS:
        # ranks inside the first bracket, then a grid of that alone
        below = _beside(rows, bracket, keys).groupBy(*keys, "share", "lo", "hi", "asked").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"))
        inside = _beside(rows, below, keys).where(F.col("v").between(F.col("lo"), F.col("hi"))).withColumn("rank", F.col("asked") - F.col("below"))
        bracket = _bracketed(inside, keys)
    met = _beside(rows, bracket, keys).where(F.col("v") <= F.col("hi")).withColumn("v", F.when(F.col("v") >= F.col("lo"), F.col("v")))
    counted = met.groupBy(*keys, "share", "asked", "v").agg(F.count("*").alias("c"))  # all below the bracket is one null
    upto = Window.partitionBy(*keys, "share").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = counted.withColumn("upto", F.sum("c").over(upto)).where((F.col("upto") >= F.col("asked")) & (F.col("upto") - F.col("c") < F.col("asked")))
    return found.groupBy(*keys).pivot("share", list(shares)).agg(F.first("v")).withColumnsRenamed(dict(zip(keys, named, strict=True)))


def _beside(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Each row beside its group's shares; null keys are a group too."""
    other = wanted.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in wanted.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(other, same).drop(*[f"_{k}" for k in keys])


def timing(value: str) -> list[Column]:
    """Median, 95th percentile and maximum of a column in which only finite values are left."""
    return [
        fixed_decimals(nearest_rank(value, 0.5), 1).alias(f"{value}_median"),
        fixed_decimals(nearest_rank(value, 0.95), 1).alias(f"{value}_p95"),
        fixed_decimals(F.max(value), 1).alias(f"{value}_max"),
    ]


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def summarize(rows: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """One row for each category, also for those without rows.

    Rows: category, expected, predicted, status, recognition_ms, decode_ms. Two
    missing labels are equal; a missing label counts as a value among the
    distinct ones. Rates are null where nothing was run.
    """
    names = categories or CATEGORIES
    dimension = rows.sparkSession.createDataFrame([(c,) for c in names], "category string")
    rows = rows.where(F.col("category").isin(names)).select(
        "category", "status", "expected", "predicted", finite(F.col("recognition_ms")).alias("recognition_ms"), finite(F.col("decode_ms")).alias("decode_ms")
    )
    decided = F.col("status") == "match"
    known = F.col("category") != "unknown"
    grouped = rows.groupBy("category").agg(
        F.count("*").alias("n"),
        F.count_if(decided).alias("decided"),
        F.count_if(F.col("status") == "uncertain").alias("uncertain"),
        F.count_if(F.col("status") == "unavailable").alias("unavailable"),
        F.count_if(decided & F.col("predicted").eqNullSafe(F.col("expected"))).alias("top1_correct"),
        (F.count_distinct("expected") + F.max(F.col("expected").isNull().cast("int"))).alias("labels"),
        *timing("recognition_ms"),
        *timing("decode_ms"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    times = [c for c in grouped.columns if "_ms_" in c]
    return F.broadcast(dimension).join(grouped, "category", "left").select(
        "category",
        zero("n").alias("n"),
        zero("decided").alias("decided"),
        zero("uncertain").alias("uncertain"),
        zero("unavailable").alias("unavailable"),
        F.when(known, zero("top1_correct")).alias("top1_correct"),
        F.when(known, F.try_divide("top1_correct", "n")).alias("top1_rate"),
        F.when(known, zero("decided") - zero("top1_correct")).alias("wrong_decisions"),
        F.when(known, zero("labels")).alias("distinct_labels"),
        F.when(~known, zero("decided")).alias("false_positives"),
        F.when(~known, F.try_divide("decided", "n")).alias("false_positive_rate"),
        *times,
    )


def outcome_rows(cases: DataFrame) -> DataFrame:
    """A prediction only where the status is a match: the first candidate."""
    return cases.withColumn("predicted", F.when(F.col("status") == "match", F.try_element_at("matches", F.lit(1))["heroId"]))


def reused_content(cases: DataFrame, references: DataFrame, content: str = "content") -> DataFrame:
    """Cases whose bytes equal a reference's, or another case's, with what they repeat."""
    marked = cases.withColumn("sha256", F.sha2(content, 256))
    known = references.select(F.sha2(content, 256).alias("sha256")).distinct()
    again = marked.groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1").select("sha256")
    return marked.join(known, "sha256", "left_semi").withColumn("repeats", F.lit("reference")).unionByName(
        marked.join(again, "sha256", "left_semi").withColumn("repeats", F.lit("case"))
    )

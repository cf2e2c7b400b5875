"""Reproducible question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import QUESTIONS
from .ordering import first_per_key

OPTIONS = 4


def candidates(heroes: DataFrame, images: DataFrame) -> DataFrame:
    """The first hero of each name among those with an image: (id, name, ordinal, variantId)."""
    usable = images.where(F.coalesce(F.octet_length("content") > 0, F.lit(False)))
    kinds = heroes.select(F.col("id").alias("heroId"), F.explode("variants").alias("v")).select("heroId", F.col("v.id").alias("variantId"), (F.col("v.kind") == "card").alias("card"))
    ranked = usable.join(kinds, ["heroId", "variantId"], "left").withColumn("card", F.coalesce("card", F.lit(False)))
    picked = first_per_key(ranked, "heroId", F.desc("card"), "imageOrdinal").select(F.col("heroId").alias("id"), "variantId")
    return first_per_key(heroes.select("id", "name", "ordinal").join(picked, "id"), "name", "ordinal")


def _shuffled(seed: int, *keys):
    """A reproducible random order: hashes of the keys."""
    return F.xxhash64(F.lit(seed), *keys)


def questions(heroes: DataFrame, images: DataFrame, seed: int, count: int = QUESTIONS) -> DataFrame:
    """``count`` questions over rounds of all candidates, no hero twice in a row, up to four options of different names.

    Fewer than two candidates give no questions. The order is a function of the seed.
    """
    pool = candidates(heroes, images)
    n = pool.count()
    if n < 2:
        return pool.sparkSession.createDataFrame([], "position int, heroId string, variantId string, options array<struct<heroId:string,name:string>>")
    rounds = -(-count // n)
    if rounds == 1:  # the set is the head of one shuffle: no task sees more than it
        pool = pool.orderBy(_shuffled(seed, F.lit(0).cast("long"), F.col("id")), "id").limit(count)
    asked = pool.crossJoin(F.broadcast(pool.sparkSession.range(rounds).select(F.col("id").alias("round"))))
    w = Window.partitionBy("round").orderBy(_shuffled(seed, F.col("round"), F.col("id")), "id")
    asked = asked.withColumn("at", F.row_number().over(w))
    # a round that would begin with the hero that ended the last one swaps its first two
    ends = Window.orderBy("round")
    edges = asked.groupBy("round").agg(F.max_by("id", "at").alias("last"), F.min_by("id", "at").alias("first"), F.max_by("id", F.when(F.col("at") == 2, 1).otherwise(0)).alias("second"))
    # a swap in a round of two changes which hero ends it, so the swaps are folded in order
    folded = F.aggregate(
        F.array_sort(F.collect_list(F.struct("round", "first", "last", "second")).over(ends.rowsBetween(Window.unboundedPreceding, 0))),
        F.struct(F.lit(None).cast("string").alias("ended"), F.lit(False).alias("swap")),
        lambda acc, r: F.struct(
            F.when(F.coalesce(r["first"] == acc["ended"], F.lit(False)) & (r["last"] == r["second"]), r["first"]).otherwise(r["last"]).alias("ended"),
            F.coalesce(r["first"] == acc["ended"], F.lit(False)).alias("swap"),
        ),
    )
    swaps = edges.select("round", folded["swap"].alias("swap"))
    at = F.when(F.col("swap") & (F.col("at") == 1), 2).when(F.col("swap") & (F.col("at") == 2), 1).otherwise(F.col("at"))
    ordered = asked.join(F.broadcast(swaps), "round").select((F.col("round") * n + at).cast("int").alias("position"), "id", "name", "variantId").where(F.col("position") <= count)
    names = first_per_key(heroes, "name", "ordinal").select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    # for each of the (at most ``count``) questions, the three first other names of a shuffle
    near = Window.partitionBy("position").orderBy(_shuffled(seed + 1, F.col("position"), F.col("other")), "other")
    others = F.broadcast(ordered).join(names, F.col("name") != F.col("other_name")).withColumn("rank", F.row_number().over(near)).where(F.col("rank") < OPTIONS)
    listed = others.groupBy("position").agg(F.collect_list(F.struct("other", "other_name")).alias("others"))
    options = F.concat(F.array(F.struct(F.col("id").alias("heroId"), F.col("name").alias("name"))), F.transform("others", lambda o: F.struct(o["other"].alias("heroId"), o["other_name"].alias("name"))))
    keyed = F.array_sort(F.transform(options, lambda o: F.struct(F.xxhash64(F.lit(seed + 2), F.col("position"), o["heroId"]).alias("k"), o.alias("o"))))
    return ordered.join(listed, "position").select("position", F.col("id").alias("heroId"), "variantId", F.transform(keyed, lambda k: k["o"]).alias("options")).orderBy("position")


def option_letters(asked: DataFrame) -> DataFrame:
    """One row for each option with its letter."""
    return asked.select("position", F.posexplode("options").alias("i", "o")).select("position", F.char(F.col("i") + 65).alias("letter"), "o.heroId", "o.name")

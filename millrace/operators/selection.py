"""Recommendation selection, searching and board layout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import haystack_match


def match_either(left: DataFrame, right: DataFrame, conditions: list[Column], key: str) -> DataFrame:
    """Left rows that meet any of several equalities with a right row, each once.

    A disjunction of equalities would be a nested loop; a semi join for each one
    hashes, and the union is reduced to one row for each key.
    """
    parts = [left.join(right, condition, "left_semi") for condition in conditions]
    return reduce(DataFrame.unionByName, parts).dropDuplicates([key])


def select_lineups(lineups: DataFrame, hero_id: str | None = None, hero_name: str | None = None, quality: str | None = None) -> DataFrame:
    """Graded lineups, those of one hero if named: carried ones first, S before A, higher order first, then input order.

    A member matches by id, or by name if it is of kind hero. A missing id matches nothing.
    ``quality`` leaves one grade; None leaves all.
    """
    graded = lineups.where(F.col("quality").isin("S", "A"))
    if quality is not None:
        graded = graded.where(F.col("quality") == quality)
    if hero_id is None:
        carry = F.lit(False)
    else:
        same = lambda m: F.coalesce(m["heroId"] == hero_id, F.lit(False)) | F.coalesce((m["kind"] == "hero") & (m["name"] == hero_name), F.lit(False))
        graded = graded.where(F.exists("members", same))
        carry = F.exists("members", lambda m: same(m) & F.coalesce(m["isCarry"], F.lit(False)))
    return graded.withColumn("carry", carry).orderBy(F.desc("carry"), F.col("quality") == "A", F.desc("sortOrder"), "ordinal")


def lineups_per_hero(heroes: DataFrame, lineups: DataFrame) -> DataFrame:
    """How many graded lineups each hero is in, by id or by name, zero included."""
    members = lineups.where(F.col("quality").isin("S", "A")).select(F.col("id").alias("lineup"), F.explode("members").alias("m"))
    by_id = members.select("lineup", F.col("m.heroId").alias("hero_key"))
    by_name = members.where("m.kind = 'hero'").select("lineup", F.col("m.name").alias("hero_name"))
    hits = (
        heroes.join(by_id, heroes["id"] == by_id["hero_key"]).select(heroes["id"], "lineup")
        .union(heroes.join(by_name, heroes["name"] == by_name["hero_name"]).select(heroes["id"], "lineup"))
        .distinct()
    )
    return heroes.join(hits, "id", "left").groupBy("id").agg(F.count("lineup").alias("lineups"))


def search(heroes: DataFrame, term: str | None = None, cost: int | None = None) -> DataFrame:
    found = heroes.where(haystack_match(F.col("name"), F.col("traits"), term))
    return found if cost is None else found.where(F.col("cost") == cost)


def grouped_by_cost(heroes: DataFrame) -> DataFrame:
    """Groups by ascending cost with counts and members in input order."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id", "name"))), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name")))
    return heroes.groupBy("cost").agg(F.count("*").alias("count"), members.alias("members")).orderBy("cost")


def equipped(members: Column) -> Column:
    return F.filter(members, lambda m: F.size(m["items"]) > 0)


def first_carry(members: Column) -> Column:
    return F.try_element_at(F.filter(members, lambda m: F.coalesce(m["isCarry"], F.lit(False))), F.lit(1))


def guide_sections(lineups: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(id, section, label, text) of a guide's fields that are not blank."""
    pairs = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.struct(F.lit(v).alias("label"), F.col(f"guide.{k}").alias("text")))])
    return lineups.select("id", F.explode(pairs).alias("section", "v")).select("id", "section", "v.label", "v.text").where(F.length(F.trim("text")) > 0)


def unpivot_stats(heroes: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(id, stat, label, value) of a map of stats; unknown stats keep their names."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    rows = heroes.select("id", F.explode(F.map_entries("stats")).alias("e"))
    return rows.select("id", F.col("e.key").alias("stat"), F.coalesce(F.try_element_at(names, F.col("e.key")), F.col("e.key")).alias("label"), F.col("e.value").alias("value"))


def board(spark: SparkSession, rows: int = 4, columns: int = 7) -> DataFrame:
    return spark.range(rows * columns).select((F.floor(F.col("id") / columns) + 1).cast("int").alias("row"), (F.col("id") % columns + 1).cast("int").alias("column"))


def on_board(row: Column, column: Column, rows: int = 4, columns: int = 7) -> Column:
    return F.coalesce(row.between(1, rows) & column.between(1, columns), F.lit(False))


def layout(members: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """All 28 cells with their members in input order, and the members without a valid place."""
    valid = on_board(F.col("position.row"), F.col("position.column"))
    placed = members.where(valid).groupBy(F.col("position.row").alias("row"), F.col("position.column").alias("column")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda m: m["name"]).alias("members")
    )
    cells = board(spark).join(placed, ["row", "column"], "left").withColumn("members", F.coalesce("members", F.array().cast("array<string>"))).orderBy("row", "column")
    return cells, members.where(~valid)


def layout_each(members: DataFrame, key: str) -> DataFrame:
    """(key, row, column, members) of the occupied cells of many boards at once, members in input order."""
    valid = on_board(F.col("position.row"), F.col("position.column"))
    return members.where(valid).groupBy(key, F.col("position.row").alias("row"), F.col("position.column").alias("column")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda m: m["name"]).alias("members")
    )


def occupancy(members: DataFrame, spark: SparkSession) -> DataFrame:
    """How many members stand on each of the 28 cells; counted before anything is moved."""
    n = members.groupBy(F.col("position.row").alias("row"), F.col("position.column").alias("column")).agg(F.count("*").alias("n"))
    return board(spark).join(n, ["row", "column"], "left").select("row", "column", F.coalesce("n", F.lit(0).cast("long")).alias("occupants"))


def cell_offsets(cells: DataFrame, size: float) -> DataFrame:
    """Pixel offsets; even rows are shifted by half a cell."""
    shift = F.when(F.col("row") % 2 == 0, size / 2).otherwise(0.0)
    return cells.withColumn("left", (F.col("column") - 1) * size + shift).withColumn("top", (F.col("row") - 1) * size)


def shown(heroes: DataFrame, no_cost: str, no_traits: str, no_text: str) -> DataFrame:
    """What a row shows of each hero (id, name, cost, traits, skill), with the given texts for what is missing."""
    text = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(no_text))
    return heroes.select(
        "id", "name", F.coalesce(F.col("cost").cast("string"), F.lit(no_cost)).alias("cost"),
        F.coalesce(F.nullif(F.array_join(F.coalesce("traits", F.array().cast("array<string>")), " / "), F.lit("")), F.lit(no_traits)).alias("traits"),
        text(F.col("skill.name")).alias("skill_name"), text(F.col("skill.description")).alias("skill_description"),
    )

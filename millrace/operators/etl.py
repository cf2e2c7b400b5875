"""Import of semi-structured feeds: rosters, greedy recommendations, formations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..functions.numbers import nonnegative
from .catalog import ordered_names
from .ordering import first_per_key
from .validation import InvalidData

#: How a published lineup is marked in the feed.
PUBLISHED_MODE, PUBLISHED_STATUS = "18", "5"

DETAIL_SCHEMA = (
    "line_name STRING, early_info STRING, d_time STRING, location_info STRING, enemy_info STRING, equipment_info STRING, hex_info STRING, "
    "adventure_info STRING, hero_location ARRAY<STRUCT<hero_id:STRING,location:STRING,chess_type:STRING,equipment_id:STRING,is_carry_hero:BOOLEAN>>"
)


def map_rows(feed: DataFrame, field: str = "data") -> DataFrame:
    """A feed's ``{id: row}`` map as rows with their key."""
    return feed.select(F.explode(field).alias("key", "row")).select("key", "row.*")


def latest_version(versions: DataFrame, mode: str, season: str) -> DataFrame:
    """The single newest version; none or several is an error."""
    found = versions.where((F.col("mode") == mode) & (F.col("season") == season) & (F.col("is_newest_version") == 1))
    if (n := len(found.limit(2).collect())) != 1:
        raise InvalidData(f"expected one latest version, found {'several' if n else 'none'}")
    return found


def published(lineups: DataFrame, edition: str, season: str, lower_season: bool = False) -> DataFrame:
    """Published S and A lineups of an edition; one importer compares the season in lower case, the other as it is."""
    column = F.lower("simulator_season") if lower_season else F.col("simulator_season")
    return lineups.where(
        (F.col("simulator_edition") == edition) & (column == season) & (F.col("mode") == PUBLISHED_MODE) & (F.col("status") == PUBLISHED_STATUS) & F.col("quality").isin("S", "A")
    )


def feed_order() -> list[Column]:
    """S before A, higher sort number first, then id as text."""
    return [F.col("quality") != "S", F.col("sortID").try_cast("double").desc_nulls_last(), F.collate("id", "UNICODE")]


def feed_keys() -> list[Column]:
    """``feed_order`` as ascending keys."""
    number = F.col("sortID").try_cast("double")
    return [F.col("quality") != "S", number.isNull(), -number, F.collate("id", "UNICODE")]


def base_roster(units: DataFrame) -> DataFrame:
    return units.where((F.col("showHeroTag") == "1") & t.matches(F.col("id"), r"^1[0-9]+$"))


def convert_heroes(units: DataFrame, races: Column, jobs: Column, patch: str) -> DataFrame:
    """Roster rows as catalogue heroes, by cost and id. ``races`` and ``jobs`` are map columns id -> name.

    Numbers that do not parse are null: ``require_complete`` reports them.
    """
    n = lambda c: nonnegative(F.col(c))
    shown = lambda c: F.format_string("%s", F.when(n(c) == F.floor(n(c)), F.floor(n(c)).cast("string")).otherwise(n(c).cast("string")))
    stats = F.create_map(
        F.lit("health"), n("initHP").cast("string"), F.lit("attackDamage"), n("initAttackDamage").cast("string"), F.lit("attackSpeed"), n("attackSpeed").cast("string"),
        F.lit("armor"), n("armor").cast("string"), F.lit("magicResist"), n("magicResist").cast("string"), F.lit("mana"), F.concat(shown("initMP"), F.lit("/"), shown("maxMP")),
        F.lit("range"), n("attackRange").cast("string"), F.lit("critChance"), F.concat(shown("criticalStrikeChance"), F.lit("%")),
    )
    traits = F.array_distinct(F.concat(ordered_names(F.col("species"), races), ordered_names(F.col("class"), jobs)))
    return units.select(
        F.concat(F.lit("hero-"), "id").alias("id"),
        "name",
        n("price").cast("int").alias("cost"),
        traits.alias("traits"),
        F.struct(t.trimmed(F.col("skillName")).alias("name"), t.trimmed(F.col("skillDesc")).alias("description")).alias("skill"),
        stats.alias("stats"),
        F.lit(patch).alias("patch"),
    ).orderBy("cost", F.collate("id", "UNICODE"))


def require_complete(heroes: DataFrame) -> None:
    """No null cost, stat or trait, no empty trait list."""
    bad = F.col("cost").isNull() | (F.size("traits") == 0) | F.exists("traits", lambda x: x.isNull()) | F.exists(F.map_values("stats"), lambda x: x.isNull())
    if rows := heroes.where(bad).select("id").limit(3).collect():
        raise InvalidData("incomplete heroes: " + ", ".join(r["id"] for r in rows))


def with_detail(lineups: DataFrame, strict: bool) -> DataFrame:
    """Parse the JSON kept in a text column. Strict: a bad one is an error; else its row is left out."""
    parsed = lineups.withColumn("d", F.from_json("detail", DETAIL_SCHEMA))
    good = F.col("d").isNotNull() & F.col("d.line_name").isNotNull() & (F.length(t.trimmed(F.col("d.line_name"))) > 0) & F.col("d.hero_location").isNotNull()
    if strict and (bad := parsed.where(~F.coalesce(good, F.lit(False))).select("id").limit(3).collect()):
        raise InvalidData("invalid detail for " + ", ".join(r["id"] for r in bad))
    return parsed.where(good)


def greedy_recommendations(slots: DataFrame, comps: int = 3) -> tuple[DataFrame, DataFrame]:
    """Each hero's first lineups with new names, and the equipment of the first of them that can be resolved.

    ``slots``: lineup_rank, slot, hero, line_name, item_ids, items_known (all ids resolve).
    The walk from lineup to lineup has a closed form. A hero's first slot in a
    lineup counts. A name is stored trimmed but compared untrimmed, so a row is
    accepted if it is the first of its trimmed name, or if trimming changes it;
    the first ``comps`` accepted rows stay, and equipment is taken from the first
    of them whose ids are not empty and all known.
    """
    one = first_per_key(slots, ["lineup_rank", "hero"], "slot").withColumn("stored", t.trimmed(F.col("line_name")))
    again = F.row_number().over(Window.partitionBy("hero", "stored").orderBy("lineup_rank"))
    new = one.withColumn("_again", again).where((F.col("_again") == 1) | (F.col("stored") != F.col("line_name"))).drop("_again")
    accepted = new.withColumn("comp_rank", F.row_number().over(Window.partitionBy("hero").orderBy("lineup_rank"))).where(F.col("comp_rank") <= comps)
    equipment = first_per_key(accepted.where((F.size("item_ids") > 0) & F.col("items_known")), "hero", "lineup_rank")
    return accepted.select("hero", "comp_rank", F.col("stored").alias("name"), "lineup_rank"), equipment.select("hero", "item_ids", "lineup_rank")


def convert_lineups(lineups: DataFrame, unit_names: Column, unit_costs: Column, item_names: Column, roster: Column) -> DataFrame:
    """Feed rows as catalogue lineups: slots in order, repeats kept. The columns are maps, ``roster`` an array of hero ids."""

    def member(slot: Column) -> Column:
        unit = slot["hero_id"]
        hero = F.concat(F.lit("hero-"), unit)
        items = F.transform(t.listed(slot["equipment_id"]), lambda i: F.struct(i.alias("id"), F.try_element_at(item_names, i).alias("name")))
        return F.struct(
            unit.alias("unitId"),
            F.when(F.array_contains(roster, hero), hero).alias("heroId"),
            F.try_element_at(unit_names, unit).alias("name"),
            F.try_element_at(unit_costs, unit).cast("int").alias("cost"),
            slot["chess_type"].alias("kind"),
            F.coalesce(slot["is_carry_hero"], F.lit(False)).alias("isCarry"),
            t.grid_position(slot["location"]).alias("position"),
            items.alias("items"),
        )

    renamed = {"early": "early_info", "reroll": "d_time", "position": "location_info", "matchups": "enemy_info", "equipment": "equipment_info", "augments": "hex_info", "adventure": "adventure_info"}
    return lineups.select(
        F.concat(F.lit("official-"), "id").alias("id"),
        F.col("id").alias("officialId"),
        t.plain_text(F.col("d.line_name")).alias("name"),
        "quality",
        F.col("sortID").try_cast("bigint").alias("sortOrder"),
        t.plain_text(F.col("lineupauthor_data.name")).alias("author"),
        F.transform("d.hero_location", member).alias("members"),
        F.struct(*[t.plain_text(F.col(f"d.{old}")).alias(new) for new, old in renamed.items()]).alias("guide"),
    )


def require_positions(lineups: DataFrame) -> None:
    """No parsed lineup has a slot whose position is some other text than row and column."""
    if rows := lineups.where(F.exists("d.hero_location", lambda slot: t.bad_position(slot["location"]))).select("id").limit(3).collect():
        raise InvalidData("a board position is malformed in " + ", ".join(r["id"] for r in rows))


def require_known(lineups: DataFrame) -> None:
    """Every unit and item of the converted lineups is known."""
    bad = F.exists("members", lambda m: m["name"].isNull() | m["cost"].isNull() | ~m["kind"].isin("hero", "pet") | F.exists(m["items"], lambda i: i["name"].isNull()))
    if rows := lineups.where((F.size("members") == 0) | bad).select("id").limit(3).collect():
        raise InvalidData("unknown unit or equipment in " + ", ".join(r["id"] for r in rows))

"""Resolving references: precedence, checked joins, ranked picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import composite_key
from .ordering import first_per_key
from .validation import InvalidData


def inner_or_raise(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Inner join in which every left row must find its partner."""
    missing = left.join(right, keys, "left_anti").select(*keys).limit(3).collect()
    if missing:
        raise InvalidData(f"missing {what}: " + ", ".join(str(tuple(r)) for r in missing))
    return left.join(right, keys)


def with_precedence(preferred: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """All preferred rows, and those fallback rows whose key the preferred ones lack."""
    return preferred.unionByName(fallback.join(preferred.select(*keys).distinct(), keys, "left_anti"))


def of_catalogue(references: DataFrame, variants: DataFrame) -> DataFrame:
    """The stored references (key, ...) whose key a hero's variant (heroId, variantId) of the catalogue has."""
    return references.join(variants.select(composite_key("heroId", "variantId").alias("key")), "key", "left_semi")


def library_counts(heroes: DataFrame, references: DataFrame, installed: DataFrame) -> DataFrame:
    """One row: heroes of the catalogue, reference images at hand, and images of the installed pack; zeros where there are none."""
    counted = heroes.agg(F.count("*").alias("heroes")).crossJoin(F.broadcast(references.agg(F.count("*").alias("references"))))
    return counted.crossJoin(F.broadcast(active_pack(installed).select(F.col("referenceCount").cast("long").alias("pack_images"), "present")))  # one row each


def gated(rows: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """The rows if the one-row ``meta`` agrees in all keys, else none."""
    return rows.join(F.broadcast(meta.select(*keys).limit(1)), keys, "left_semi")


def asset_records(manifest: DataFrame, catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """A pack's references resolved to images: hero, variant and entry must exist, keys be unique."""
    refs = manifest.select(F.explode("references").alias("r")).select("r.heroId", "r.variantId", "r.path")
    variants = catalog.select(F.explode("heroes").alias("h")).select(F.col("h.id").alias("heroId"), F.explode("h.variants.id").alias("variantId"))
    refs = inner_or_raise(refs, variants.distinct(), ["heroId", "variantId"], "hero or variant")
    if refs.groupBy("heroId", "variantId").count().where("count > 1").head(1):
        raise InvalidData("duplicate image for one hero and variant")
    found = inner_or_raise(refs, entries.select("path", "content"), ["path"], "image")
    return found.select(F.concat_ws("/", "heroId", "variantId").alias("key"), "heroId", "variantId", "path", "content")


def hero_image(heroes: DataFrame, images: DataFrame) -> DataFrame:
    """Each hero's image: one of kind card if there is any, else the first; only images with bytes."""
    usable = images.where(F.coalesce(F.octet_length("content") > 0, F.lit(False)))
    kinds = heroes.select("id", F.explode("variants").alias("v")).select(F.col("id").alias("heroId"), F.col("v.id").alias("variantId"), F.col("v.kind").alias("kind"))
    ranked = usable.join(kinds, ["heroId", "variantId"], "left").withColumn("_card", F.coalesce(F.col("kind") == "card", F.lit(False)))
    return heroes.select("id", "name", "ordinal").join(
        first_per_key(ranked, "heroId", F.desc("_card"), "imageOrdinal").drop("_card"), F.col("id") == F.col("heroId"), "left"
    )


def with_image(heroes: DataFrame, images: DataFrame) -> DataFrame:
    usable = images.where(F.coalesce(F.octet_length("content") > 0, F.lit(False)))
    return heroes.join(usable, heroes["id"] == usable["heroId"], "left_semi")


def by_id_then_name(rows: DataFrame, heroes: DataFrame, id_column: str, name_column: str) -> DataFrame:
    """The hero found by id, else by name (the first of that name)."""
    by_id = heroes.select(F.col("id").alias("_id"), F.struct("id", "name").alias("_by_id"))
    by_name = first_per_key(heroes, "name", "ordinal").select(F.col("name").alias("_name"), F.struct("id", "name").alias("_by_name"))
    return (
        rows.join(by_id, rows[id_column] == by_id["_id"], "left")
        .join(by_name, rows[name_column] == by_name["_name"], "left")
        .withColumn("hero", F.coalesce("_by_id", "_by_name"))
        .drop("_id", "_name", "_by_id", "_by_name")
    )


def wrong_answers(answers: DataFrame, heroes: DataFrame) -> DataFrame:
    """Wrong answers with the names of the right and of the chosen hero."""
    truth = heroes.select(F.col("id").alias("heroId"), F.col("name").alias("right_name"))
    chosen = heroes.select(F.col("id").alias("selectedHeroId"), F.col("name").alias("chosen_name"))
    return answers.where(~F.col("correct")).join(truth, "heroId", "left").join(chosen, "selectedHeroId", "left")


def detail_sources(sources: DataFrame, fixed: list[str], guide_ids: DataFrame) -> DataFrame:
    """Sources named by a fixed list or by a guide."""
    wanted = guide_ids.select(F.col("source_id").alias("id")).union(guide_ids.sparkSession.createDataFrame([(x,) for x in fixed], "id string"))
    return sources.join(wanted.distinct(), "id", "left_semi")


def ordered_names(ids, names, drop=("", "0", "-1"), sign: str = r"\|"):
    """Names of listed ids in order, each once; ``names`` is a map column; unknown ids give null entries."""
    kept = F.filter(F.split(F.coalesce(ids, F.lit("")), sign), lambda x: ~x.isin(*drop))
    return F.array_distinct(F.transform(kept, lambda x: F.try_element_at(names, x)))


def stale(pack_season, pack_patch, season, patch):
    """The pack belongs to another season or patch; no pack is not stale."""
    return F.coalesce(~pack_season.eqNullSafe(season) | ~pack_patch.eqNullSafe(patch), F.lit(False)) & pack_season.isNotNull()


def required_sources(sources: DataFrame, ids: list[str], checked_at: str) -> DataFrame:
    """The named sources in the given order with a new check date; a missing one is an error."""
    wanted = sources.sparkSession.createDataFrame(list(enumerate(ids)), "at int, id string")
    found = inner_or_raise(wanted, sources, ["id"], "source")
    return found.withColumn("checkedAt", F.lit(checked_at)).orderBy("at").drop("at")


def official_url(url, host: str, prefix: str):
    """An https address on this host below this path, without user, port or query."""
    parsed = lambda part: F.try_parse_url(url, F.lit(part))
    return F.coalesce(
        (parsed("PROTOCOL") == "https") & (parsed("AUTHORITY") == host) & F.startswith(parsed("PATH"), F.lit(prefix)) & parsed("QUERY").isNull() & ~F.contains(parsed("PATH"), F.lit("..")),
        F.lit(False),
    )


def art_references(heroes: DataFrame, units: DataFrame, host: str, prefix: str) -> DataFrame:
    """Two image references for each catalogue hero, from the current feed.

    Every hero must be in the feed with the same name and price, and every address
    be official and used once; else the catalogue is not fresh and nothing is built.
    """
    feed = units.select(F.concat(F.lit("hero-"), "id").alias("id"), F.col("name").alias("_name"), F.col("price").try_cast("int").alias("_cost"), "picture", "heroPaint")
    both = inner_or_raise(heroes.select("id", "name", "cost"), feed, ["id"], "hero in the current feed")
    if old := both.where(~(F.col("name").eqNullSafe(F.col("_name")) & F.col("cost").eqNullSafe(F.col("_cost")))).select("id").limit(3).collect():
        raise InvalidData("the catalog is stale for " + ", ".join(r["id"] for r in old))
    variants = F.array(F.struct(F.lit("card").alias("variantId"), F.col("picture").alias("url")), F.struct(F.lit("splash").alias("variantId"), F.col("heroPaint").alias("url")))
    refs = both.select(F.col("id").alias("heroId"), F.explode(variants).alias("v")).select("heroId", "v.variantId", "v.url")
    if bad := refs.where(~official_url(F.col("url"), host, prefix)).select("heroId").limit(3).collect():
        raise InvalidData("unexpected image address for " + ", ".join(r["heroId"] for r in bad))
    if refs.groupBy("url").count().where("count > 1").head(1):
        raise InvalidData("one image address is used twice")
    return refs


def active_pack(meta: DataFrame):
    """State of the stored pack: its season, patch and size, or the empty state."""
    return meta.agg(F.max("seasonId").alias("seasonId"), F.max("patch").alias("patch"), F.coalesce(F.max("referenceCount"), F.lit(0)).alias("referenceCount"), (F.count("*") > 0).alias("present"))

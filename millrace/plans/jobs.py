"""Whole jobs: from feeds to catalogues, from cases to a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import aspect_bucket, fixed_decimals
from ..functions.text import image_mime, listed
from ..operators import catalog as cat
from ..operators import etl, evaluation, ordering, validation, vision
from ..session import once
from ..sources import archives, feeds


def name_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A one-row frame with a dictionary feed (hundreds of rows) as a map column."""
    return rows.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("names"))


def import_heroes(units: DataFrame, races: DataFrame, jobs: DataFrame, patch: str) -> DataFrame:
    """Units (rows), races and jobs (key, name) to checked catalogue heroes."""
    both = etl.base_roster(units).crossJoin(F.broadcast(name_map(races, "key", "name").withColumnRenamed("names", "races"))).crossJoin(
        F.broadcast(name_map(jobs, "key", "name").withColumnRenamed("names", "jobs"))
    )
    heroes = etl.convert_heroes(both, F.col("races"), F.col("jobs"), patch)
    etl.require_complete(heroes)
    return heroes


def import_season(versions: DataFrame, mode: str, season: str, units: DataFrame, races: DataFrame, jobs: DataFrame, heroes: int) -> DataFrame:
    """The newest version's catalogue heroes. ``units``, ``races`` and ``jobs`` are whole feeds.

    Not one newest version, a feed of another version, or another number of heroes,
    ids or names than ``heroes`` is an error.
    """
    version = etl.latest_version(versions, mode, season).head()["version"]
    for name, feed in (("units", units), ("races", races), ("jobs", jobs)):
        if feed.select("version").head()["version"] != version:
            raise validation.InvalidData(f"the {name} feed is of another version")
    done = import_heroes(*[etl.map_rows(feed) for feed in (units, races, jobs)], version)
    validation.require_counts(done, heroes, "id", "name")
    return done


def load_lineups(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """A stored catalogue of lineups; a broken rule, or another season or patch than the hero catalogue's, is an error."""
    data = feeds.json_documents(spark, path, feeds.LINEUP_SCHEMA)
    validation.require_valid(validation.lineup_violations(data, catalog))
    return data


def content_version(catalog: DataFrame, lineups: DataFrame) -> DataFrame:
    """(contentVersion, updatedAt): the catalogue's patch and the later day of the two catalogues."""
    later = catalog.select("updatedAt").union(lineups.select("updatedAt")).agg(F.max("updatedAt").alias("updatedAt"))
    return catalog.select(F.col("patch").alias("contentVersion")).crossJoin(F.broadcast(later))  # one row each


def recommendation_slots(lineups: DataFrame, roster: DataFrame, items: DataFrame) -> DataFrame:
    """Parsed lineups in feed order to the slots the greedy selection takes; units outside the roster are left out."""
    ranked = ordering.numbered(lineups, etl.feed_keys(), into="lineup_rank").withColumn("lineup_rank", F.col("lineup_rank").cast("int"))
    slots = ranked.select("lineup_rank", F.col("d.line_name").alias("line_name"), F.posexplode("d.hero_location").alias("slot", "s")).where("s.chess_type = 'hero'")
    slots = slots.select("lineup_rank", "slot", F.col("s.hero_id").alias("hero"), "line_name", F.slice(listed(F.col("s.equipment_id")), 1, 3).alias("item_ids"))
    known = name_map(items, "key", "name")
    return (
        slots.join(F.broadcast(roster.select(F.col("id").alias("hero")).distinct()), "hero", "left_semi")
        .crossJoin(F.broadcast(known))
        .withColumn("items_known", F.forall("item_ids", lambda i: F.coalesce(F.length(F.try_element_at("names", i)) > 0, F.lit(False))))
        .drop("names")
    )


def load_pack(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, records) of one asset pack; a problem in the archive, a bad image or a missing reference is an error."""
    entries = archives.archive_entries(spark, path)
    if bad := entries.where("problem IS NOT NULL").head():
        raise validation.InvalidData(bad["problem"])
    schema = f"schemaVersion INT, seasonId STRING, patch STRING, catalog STRUCT<{_struct(feeds.CATALOG_SCHEMA)}>, references ARRAY<STRUCT<heroId:STRING,variantId:STRING,path:STRING>>"
    root = entries.where("path = 'manifest.json'")
    if root.where(F.octet_length("content") > feeds.MANIFEST_BYTES).head(1):
        raise validation.InvalidData("manifest.json is over 1 MB")
    manifest = root.select(F.from_json(F.col("content").cast("string"), schema).alias("m"), F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"))
    manifest = manifest.where("utf8").select("m.*")
    if not manifest.where("schemaVersion = 1").head(1):
        raise validation.InvalidData("a pack needs a root manifest.json of version 1")
    catalog = manifest.select("catalog.*")
    validation.require_valid(validation.catalog_violations(catalog))
    if not manifest.where((F.col("seasonId") == F.col("catalog.seasonId")) & (F.col("patch") == F.col("catalog.patch"))).head(1):
        raise validation.InvalidData("season and patch must match the catalog")
    records = cat.asset_records(manifest, catalog, entries).withColumn("mime", image_mime(F.col("content"), F.col("path")))
    if bad := records.where("mime IS NULL").head():
        raise validation.InvalidData(f"{bad['path']} must be a PNG, JPEG or WebP image matching its extension")
    return manifest, records


def _struct(ddl: str) -> str:
    """Top-level DDL columns as struct fields."""
    out, depth = [], 0
    for part in ddl.split(", "):
        if depth == 0:
            name, kind = part.split(" ", 1)
            part = f"{name}:{kind}"
        depth += part.count("<") - part.count(">")
        out.append(part)
    return ",".join(out)


def recognize(images: DataFrame, references: DataFrame, most: int = 960) -> DataFrame:
    """Cases (id, width, height, rgba) against references (heroId, variantId, ordinal, width, height, rgba): status, reason and matches.

    Signatures of references are made once; windows meet references of their
    aspect bucket only; each bucket's best references are searched for again at
    the precision of pixels; every stage before the decision is partitioned by
    image. Matches carry their box in the case's own pixels, their evidence, the hash
    bits in which they differ from the reference and how near their colours are.
    Without references, without a usable one, or without a readable image of at
    least 16 by 16 a case is unavailable.
    """
    long, short = F.greatest("width", "height"), F.least("width", "height")
    scale = F.least(F.lit(1.0), most / long)
    side = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * scale + 0.5)).cast("int")
    readable = validation.pixels_valid(F.col("width"), F.col("height"), F.col("rgba")) & (short >= 16) & (F.least(side("width"), side("height")) >= 16)
    cases = images.select(F.col("id").alias("case"), "width", "height", side("width").alias("w"), side("height").alias("h"), readable.alias("readable"))
    given = references.where("heroId IS NOT NULL AND heroId <> '' AND rgba IS NOT NULL")
    known = vision.usable(vision.signatures(given)).withColumn("aspect", F.col("width") / F.col("height")).withColumn("aspect_bucket", aspect_bucket(F.col("aspect")))
    known = once(known.select("heroId", "variantId", "ordinal", "aspect", "aspect_bucket", "signature"))
    buckets = [r["aspect_bucket"] for r in known.groupBy("aspect_bucket").agg(F.min("ordinal").alias("o")).orderBy("o").collect()]  # a few dozen possible values
    absent = None if buckets else "no_usable_references" if references.head(1) else "no_references"
    windows = once(vision.scan_windows(images.where(readable), buckets, most).withColumnRenamed("id", "case"))
    coarse = once(vision.best_windows(windows, known))
    settled = vision.refine(images.where(readable), vision.leaders(coarse), most)
    found = ["score", "box", "hashDistance", "colorScore"]
    settled = settled.select("case", "ordinal", *[F.col(c).alias(f"settled_{c}") for c in found])
    best = coarse.join(settled, ["case", "ordinal"], "left").withColumns({c: F.coalesce(f"settled_{c}", c) for c in found})
    placed = best.join(cases, "case").withColumns({
        "box": vision.scaled_box(F.col("box"), F.col("w"), F.col("width"), F.col("h"), F.col("height")),
        "evidence": F.struct(F.lit("phash").alias("method"), "variantId"),
        "colorScore": fixed_decimals(F.col("colorScore"), 3),
    })
    heroes = vision.best_per_hero(placed, ["case"], "box", "evidence", "hashDistance", "colorScore").withColumn("method", F.col("evidence.method"))
    reason = F.when(F.lit(absent == "no_references"), "no_references").when(~F.coalesce("readable", F.lit(False)), "image_decode_failed").when(F.lit(absent is not None), absent)
    return cases.join(vision.decide(heroes, ["case"]), "case", "left").select(
        "case",
        F.when(reason.isNotNull(), "unavailable").otherwise(F.coalesce("status", F.lit("uncertain"))).alias("status"),
        F.coalesce(reason, "reason", F.lit("insufficient_evidence")).alias("reason"),
        F.when(reason.isNull(), F.col("matches")).alias("matches"),
    )


def name_tied(results: DataFrame, heroes: DataFrame, ocr: DataFrame, least_confidence: float = 75.0) -> DataFrame:
    """``recognize``'s results with ties broken by the names read (case, status, text, confidence); heroes: id, name, aliases."""
    three = results.select("case", F.explode(F.slice("matches", 1, 3)).alias("m")).select("case", F.col("m.heroId").alias("heroId"))
    candidates = three.join(heroes.select(F.col("id").alias("heroId"), "name", "aliases"), "heroId", "left")
    hits = vision.named_candidate(ocr, candidates, least_confidence)
    return vision.break_ties(results.withColumn("orb_available", F.lit(False)), hits).drop("orb_available")


def import_lineups(lineups: DataFrame, units: DataFrame, items: DataFrame, roster: DataFrame, edition: str, season: str, feed_version: tuple[str, str, str]) -> DataFrame:
    """Feed rows to checked catalogue lineups in feed order.

    ``units`` and ``items`` are whole feeds (version, season, setId, data), which
    must be of ``feed_version``; ``roster`` holds the catalogue's hero ids. Broken
    detail texts, malformed board positions, unknown units and items are errors.
    """
    for name, feed in (("units", units), ("items", items)):
        if tuple(feed.select("version", "season", "setId").head() or ()) != feed_version:
            raise validation.InvalidData(f"the {name} feed is of another version, season or set")
    parsed = etl.with_detail(etl.published(lineups, edition, season), strict=True)
    etl.require_positions(parsed)
    unit, item = etl.map_rows(units), etl.map_rows(items)
    maps = name_map(unit, "key", "name").withColumnRenamed("names", "unit_names")
    maps = maps.crossJoin(name_map(unit, "key", "price").withColumnRenamed("names", "unit_costs")).crossJoin(name_map(item, "key", "name").withColumnRenamed("names", "item_names"))
    maps = maps.crossJoin(roster.agg(F.collect_set("id").alias("roster")))  # dictionaries of a season: hundreds of entries
    done = etl.convert_lineups(parsed.crossJoin(F.broadcast(maps)), F.col("unit_names"), F.col("unit_costs"), F.col("item_names"), F.col("roster"))
    etl.require_known(done)
    return done.orderBy(F.col("quality") != "S", F.desc_nulls_last("sortOrder"), F.collate("officialId", "UNICODE"))


def report(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Labelled cases and their results to the summary by category."""
    rows = evaluation.outcome_rows(cases.join(results, "case"))
    return evaluation.summarize(rows.select("category", "status", F.col("expectedHeroId").alias("expected"), "predicted", "recognition_ms", "decode_ms"))

"""Constraint rules as data: every rule gives rows (path, reason); strict callers raise on the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.numbers import whole_in

#: Closed enumerations and limits of the catalogues.
STATUSES = ("verified", "user-provided", "unverified")
VARIANT_KINDS = ("card", "splash")
GRADES = ("S", "A")
MEMBER_KINDS = ("hero", "pet")
GUIDE_KEYS = ("early", "reroll", "position", "matchups", "equipment", "augments", "adventure")
CASE_CATEGORIES = ("game", "splash", "unknown")
DATASET_KINDS = ("independent", "synthetic-smoke")


class InvalidData(ValueError):
    """Raised by ``require_valid`` with the first violations."""


def violations(frame: DataFrame, rules: list[tuple[Column, Column, str]]) -> DataFrame:
    """(path, reason) of every rule that a row breaks: one pass, whatever the number of rules.

    A rule is (what must hold, the path, the reason); null does not hold.
    """
    found = F.array_compact(
        F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.struct(path.alias("path"), F.lit(reason).alias("reason"))) for holds, path, reason in rules])
    )
    return frame.select(F.explode(found).alias("v")).select("v.path", "v.reason")


def duplicates(frame: DataFrame, keys: list[str], path: Column, reason: str = "key occurs more than once") -> DataFrame:
    """One violation for each repeated key; counted before anything but counts is moved."""
    return frame.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(path.alias("path"), F.lit(reason).alias("reason"))


def unknown_references(rows: DataFrame, key: str, known: DataFrame, known_key: str, path: Column, reason: str) -> DataFrame:
    """Rows whose key is not among the known ones (a null key is unknown)."""
    return rows.join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti").select(path.alias("path"), F.lit(reason).alias("reason"))


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require_valid(found: DataFrame, show: int = 5) -> None:
    """Raise if there is a violation; only the first few reach the driver."""
    if first := found.orderBy("path", "reason").limit(show).collect():
        raise InvalidData("; ".join(f"{r['path']}: {r['reason']}" for r in first))


def _at(prefix: str, ordinal: str, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix + "["), F.col(ordinal).cast("string"), F.lit("]" + suffix))


def _path(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _source_rules(catalog: DataFrame, instants: bool) -> list[DataFrame]:
    sources = catalog.select(F.posexplode("sources").alias("i", "s"))
    day = t.is_day_or_instant(F.col("s.checkedAt")) if instants else t.is_day(F.col("s.checkedAt"))
    return [
        violations(
            sources,
            [
                (t.matches(F.col("s.id"), t.ID_PATTERN), _at("sources", "i", ".id"), "not an id of small letters, digits and hyphens"),
                (t.has_text(F.col("s.title"), 200), _at("sources", "i", ".title"), "text is missing or too long"),
                (t.has_text(F.col("s.url"), 1000) & t.is_https(F.col("s.url")), _at("sources", "i", ".url"), "address is not an https one"),
                (day, _at("sources", "i", ".checkedAt"), "not a calendar day or instant"),
            ],
        ),
        duplicates(sources.select(F.col("s.id").alias("id")), ["id"], F.lit("sources")),
    ]


def catalog_violations(catalog: DataFrame) -> DataFrame:
    """All broken rules of a one-row catalogue of heroes."""
    heroes = catalog.select("patch", F.posexplode("heroes").alias("h", "hero")).select("patch", "h", "hero.*")
    hero = lambda suffix: _path("heroes[", F.col("h"), "]" + suffix)
    root = [
        (F.col("schemaVersion") == 1, F.lit("schemaVersion"), "schema version is not 1"),
        (t.matches(F.col("seasonId"), t.ID_PATTERN), F.lit("seasonId"), "not an id of small letters, digits and hyphens"),
        (t.has_text(F.col("seasonName"), 120), F.lit("seasonName"), "text is missing or too long"),
        (t.has_text(F.col("patch"), 80), F.lit("patch"), "text is missing or too long"),
        (t.is_day_or_instant(F.col("updatedAt")), F.lit("updatedAt"), "not a calendar day or instant"),
        (F.col("status").isin(*STATUSES), F.lit("status"), "status is not in the list"),
        (F.size("sources") <= 100, F.lit("sources"), "list is longer than allowed"),
        (F.size("heroes") <= 400, F.lit("heroes"), "list is longer than allowed"),
        ((F.size("heroes") == 0) | (F.col("status") == "unverified") | (F.size("sources") > 0), F.lit("sources"), "entries without any source"),
        ((F.col("status") != "verified") | (F.size("heroes") > 0), F.lit("heroes"), "verified, yet without entries"),
    ]
    hero_rules = [
        (t.matches(F.col("id"), t.ID_PATTERN), hero(".id"), "not an id of small letters, digits and hyphens"),
        (t.has_text(F.col("name"), 120), hero(".name"), "text is missing or too long"),
        (whole_in(F.col("cost"), 0, 10), hero(".cost"), "cost is no whole number between 0 and 10"),
        ((F.size("traits") <= 12) & F.forall("traits", lambda x: t.has_text(x, 100)), hero(".traits"), "an entry is missing or too long"),
        (t.has_text(F.col("skill.name"), 120) & t.has_text(F.col("skill.description"), 3000), hero(".skill"), "text is missing or too long"),
        (F.size("stats") <= 40, hero(".stats"), "more than 40 values"),
        (
            F.forall(F.map_values("stats"), lambda s: (F.length(F.trim(s)) > 0) & (F.length(s) <= 100) & (s.try_cast("double").isNull() | (s.try_cast("double") >= 0))),
            hero(".stats"),
            "value is neither a number from 0 up nor a short text",
        ),
        (F.col("recommendations.patch") == F.col("patch"), hero(".recommendations.patch"), "patch differs from the catalogue's"),
        ((F.size("recommendations.items") <= 30) & F.forall("recommendations.items", lambda x: t.has_text(x["name"], 150)), hero(".recommendations.items"), "an entry has no name, or there are too many"),
        ((F.size("recommendations.comps") <= 30) & F.forall("recommendations.comps", lambda x: t.has_text(x["name"], 150)), hero(".recommendations.comps"), "an entry has no name, or there are too many"),
        (F.size("variants") <= 30, hero(".variants"), "list is longer than allowed"),
        (F.forall("variants", lambda v: t.matches(v["id"], t.ID_PATTERN)), hero(".variants"), "not an id of small letters, digits and hyphens"),
        (F.forall("variants", lambda v: v["kind"].isin(*VARIANT_KINDS)), hero(".variants"), "kind is not in the list"),
        (F.forall("variants", lambda v: v["url"].isNull() | t.safe_image_path(v["url"])), hero(".variants"), "not a path below the site's own assets"),
        (F.size("variants") == F.size(F.array_distinct(F.transform("variants", lambda v: v["id"]))), hero(".variants"), "key occurs more than once"),
    ]
    named = heroes.select("h", F.posexplode("recommendations.sourceIds").alias("i", "source_id"))
    sources = catalog.select(F.explode("sources.id").alias("id"))
    unknown = unknown_references(named, "source_id", sources, "id", _path("heroes[", F.col("h"), "].recommendations.sourceIds[", F.col("i"), "]"), "no source has this id")
    return all_of([violations(catalog, root), *_source_rules(catalog, True), violations(heroes, hero_rules), duplicates(heroes, ["id"], F.lit("heroes")), unknown])


def lineup_violations(data: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """All broken rules of a one-row catalogue of lineups, with a hero catalogue also of its fit to that."""
    lineups = data.select(F.posexplode("lineups").alias("l", "x")).select("l", "x.*")
    members = lineups.select("l", F.posexplode("members").alias("m", "v")).select("l", "m", "v.*")
    line = lambda suffix: _path("lineups[", F.col("l"), "]" + suffix)
    slot = lambda suffix: _path("lineups[", F.col("l"), "].members[", F.col("m"), "]" + suffix)
    root = [
        (F.col("schemaVersion") == 1, F.lit("schemaVersion"), "schema version is not 1"),
        (t.matches(F.col("seasonId"), t.ID_PATTERN), F.lit("seasonId"), "not an id of small letters, digits and hyphens"),
        (t.has_text(F.col("seasonName"), 120), F.lit("seasonName"), "text is missing or too long"),
        (t.has_text(F.col("patch"), 80), F.lit("patch"), "text is missing or too long"),
        (t.is_day(F.col("updatedAt")), F.lit("updatedAt"), "not a calendar day or instant"),
        (F.col("status") == "verified", F.lit("status"), "data is not verified"),
        (F.size("sources").between(1, 20), F.lit("sources"), "number of sources is not between 1 and 20"),
        (F.size("lineups").between(1, 200), F.lit("lineups"), "number of lineups is not between 1 and 200"),
    ]
    refs = F.col("sourceIds")
    rules = [
        (t.matches(F.col("officialId"), t.UNIT_PATTERN), line(".officialId"), "id is not made of digits"),
        (t.matches(F.col("id"), t.ID_PATTERN) & (F.col("id") == F.concat(F.lit("official-"), F.col("officialId"))), line(".id"), "id does not follow from officialId"),
        (t.has_text(F.col("name"), 200), line(".name"), "text is missing or too long"),
        (F.col("quality").isin(*GRADES), line(".quality"), "grade is not in the list"),
        ((F.col("sortOrder") >= 0) & (F.col("sortOrder") <= (1 << 53) - 1), line(".sortOrder"), "order is no whole number from 0 up"),
        (F.char_length("author") <= 200, line(".author"), "text is missing or too long"),
        (F.size(refs).between(1, 20) & F.array_contains(refs, "lineups"), line(".sourceIds"), "the lineup feed is not among the sources"),
        (F.size(refs) == F.size(F.array_distinct(refs)), line(".sourceIds"), "key occurs more than once"),
        (F.size("members").between(1, 40), line(".members"), "number of members is not between 1 and 40"),
        *[(F.char_length(F.col(f"guide.{k}")) <= 6000, line(f".guide.{k}"), "text is missing or too long") for k in GUIDE_KEYS],
    ]
    slot_rules = [
        (t.matches(F.col("unitId"), t.UNIT_PATTERN), slot(".unitId"), "unit id is not made of digits"),
        (t.has_text(F.col("name"), 120), slot(".name"), "text is missing or too long"),
        (F.col("kind").isin(*MEMBER_KINDS), slot(".kind"), "kind of member is not in the list"),
        (whole_in(F.col("cost"), 0, 10), slot(".cost"), "cost is no whole number between 0 and 10"),
        (F.col("isCarry").isNotNull(), slot(".isCarry"), "carry flag is missing"),
        (F.col("heroId").isNull() | (F.col("heroId") == F.concat(F.lit("hero-"), F.col("unitId"))), slot(".heroId"), "hero id does not follow from unitId"),
        (F.col("position").isNull() | (F.col("position.row").between(1, 4) & F.col("position.column").between(1, 7)), slot(".position"), "cell lies outside the board"),
        ((F.size("items") <= 3) & F.forall("items", lambda i: t.matches(i["id"], t.UNIT_PATTERN) & t.has_text(i["name"], 120)), slot(".items"), "equipment is unnamed, unknown or more than three"),
    ]
    named = lineups.select("l", F.posexplode("sourceIds").alias("i", "source_id"))
    sources = data.select(F.explode("sources.id").alias("id"))
    parts = [
        violations(data, root),
        *_source_rules(data, False),
        violations(lineups, rules),
        violations(members, slot_rules),
        duplicates(lineups, ["id"], F.lit("lineups")),
        unknown_references(named, "source_id", sources, "id", _path("lineups[", F.col("l"), "].sourceIds[", F.col("i"), "]"), "no source has this id"),
    ]
    if catalog is not None:
        other = catalog.select(F.col("seasonId").alias("s"), F.col("patch").alias("p"))
        fits = data.join(F.broadcast(other), (F.col("seasonId") == F.col("s")) & (F.col("patch") == F.col("p")), "left_anti")
        parts.append(fits.select(F.lit("patch").alias("path"), F.lit("season or patch differs from the hero catalogue's").alias("reason")))
        heroes = catalog.select(F.explode("heroes").alias("h")).select(F.col("h.id").alias("heroId"), F.col("h.name").alias("hero_name"), F.col("h.cost").alias("hero_cost"))
        wrong = members.where("heroId IS NOT NULL").join(heroes, "heroId", "left").where(~(F.col("hero_name").eqNullSafe(F.col("name")) & F.col("hero_cost").eqNullSafe(F.col("cost"))))
        parts.append(wrong.select(slot(".heroId").alias("path"), F.lit("name or cost differs from the hero catalogue's").alias("reason")))
    return all_of(parts)


def manifest_violations(manifest: DataFrame, catalog: DataFrame, allow_synthetic: bool = False) -> DataFrame:
    """All broken rules of a one-row manifest of labelled cases."""
    cases = manifest.select("datasetKind", F.posexplode("cases").alias("c", "x")).select("datasetKind", "c", "x.*")
    case = lambda suffix: _path("cases[", F.col("c"), "]" + suffix)
    other = catalog.select(F.col("seasonId").alias("s"), F.col("patch").alias("p"), F.col("heroes.id").alias("hero_ids"))
    both = manifest.crossJoin(F.broadcast(other.limit(1)))
    kinds = DATASET_KINDS if allow_synthetic else DATASET_KINDS[:1]
    root = [
        (F.col("schemaVersion") == 1, F.lit("schemaVersion"), "schema version is not 1"),
        ((F.col("seasonId") == F.col("s")) & (F.col("patch") == F.col("p")), F.lit("patch"), "season or patch differs from the pack's"),
        (F.col("datasetKind").isin(*kinds), F.lit("datasetKind"), "kind of data set is not allowed"),
        (F.size("cases").between(1, 500), F.lit("cases"), "number of cases is not between 1 and 500"),
    ]
    labelled = cases.where(F.col("category") != "unknown")
    heroes = catalog.select(F.explode("heroes.id").alias("id"))
    rules = [
        (t.matches(F.col("id"), r"^[a-z0-9][a-z0-9_-]{0,79}$"), case(".id"), "case id has other signs than small letters, digits, _ and -"),
        (F.col("category").isin(*CASE_CATEGORIES), case(".category"), "category is not in the list"),
        ((F.col("category") != "unknown") | F.col("expectedHeroId").isNull(), case(".expectedHeroId"), "a case without a hero has a label"),
        ((F.col("datasetKind") != "independent") | t.matches(F.col("sourceId"), r"^[a-z0-9][a-z0-9_-]{0,79}$"), case(".sourceId"), "source id is missing or malformed"),
        (t.safe_entry_path(F.col("path")), case(".path"), "path leaves its folder"),
    ]
    return all_of(
        [
            violations(both, root),
            violations(cases, rules),
            duplicates(cases, ["id"], F.lit("cases.id")),
            duplicates(cases, ["path"], F.lit("cases.path"), "path stands in several cases"),
            duplicates(cases.where("datasetKind = 'independent' AND sourceId IS NOT NULL"), ["sourceId"], F.lit("cases.sourceId"), "source stands in several cases"),
            unknown_references(labelled, "expectedHeroId", heroes, "id", case(".expectedHeroId"), "label is no hero of the catalogue"),
        ]
    )


def pixels_valid(width: Column, height: Column, rgba: Column) -> Column:
    """The buffer holds width * height pixels of four bytes."""
    return F.coalesce((width > 0) & (height > 0) & (F.octet_length(rgba) == width * height * 4), F.lit(False))


def require_counts(frame: DataFrame, expected: int, *distinct: str) -> None:
    """Exactly so many rows, with as many distinct values in each named column."""
    row = frame.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(c) for c in distinct]).first()
    if any(v != expected for v in row):
        raise InvalidData(f"expected {expected} rows and distinct {', '.join(distinct)}, found {row.asDict()}")

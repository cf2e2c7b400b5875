"""Images as rows, official addresses, fresh catalogues, feeds and the roster import."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import catalog, etl, selection, validation
from millrace.plans import jobs
from millrace.sources import feeds, images


def png(pixels):
    height, width = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pixels_come_back(spark, tmp_path):
    pixels = np.random.default_rng(1).integers(0, 255, (20, 17, 4), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png(pixels))
    (tmp_path / "b.png").write_bytes(b"no image")
    (tmp_path / "empty.png").write_bytes(b"")
    rows = images.image_pixels(spark, str(tmp_path)).collect()
    assert [(r["width"], r["height"]) for r in rows] == [(17, 20)]
    assert (np.frombuffer(rows[0]["rgba"], np.uint8).reshape(20, 17, 4) == pixels).all()
    assert {r["path"].rsplit("/", 1)[1] for r in images.case_files(spark, str(tmp_path)).collect()} == {"a.png", "b.png"}


def test_official_urls(spark):
    urls = ["https://a.example/img/x.png", "http://a.example/img/x.png", "https://b.example/img/x.png", "https://a.example/other/x.png", "https://u@a.example/img/x.png", "https://a.example/img/../x.png", "https://a.example/img/x.png?q=1", "no url", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(catalog.official_url(F.col("u"), "a.example", "/img/").alias("ok")).collect()
    assert [r["ok"] for r in got] == [True] + [False] * 8


def test_art_needs_a_fresh_catalogue(spark):
    heroes = spark.createDataFrame([("hero-1", "One", 1), ("hero-2", "Two", 2)], "id string, name string, cost int")
    unit = lambda i, name, price, art=None: (i, name, price, f"https://a.example/img/{art or i}c.png", f"https://a.example/img/{art or i}s.png")
    schema = "id string, name string, price string, picture string, heroPaint string"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    refs = catalog.art_references(heroes, frame(unit("1", "One", "1"), unit("2", "Two", "2"), unit("3", "x", "3")), "a.example", "/img/")
    assert refs.count() == 4
    for rows in ([unit("1", "One", "1")], [unit("1", "One", "1"), unit("2", "Two", "3")], [unit("1", "One", "1"), unit("2", "Two", "2", "1")]):
        with pytest.raises(validation.InvalidData):
            catalog.art_references(heroes, frame(*rows), "a.example", "/img/")
    with pytest.raises(validation.InvalidData):
        catalog.art_references(heroes, frame(unit("1", "One", "1"), unit("2", "Two", "2")), "b.example", "/img/")


def test_required_sources(spark):
    sources = spark.createDataFrame([("a", "A", "2024-01-01"), ("b", "B", "2024-01-01")], "id string, title string, checkedAt string")
    got = catalog.required_sources(sources, ["b", "a"], "2024-02-02").collect()
    assert [(r["id"], r["checkedAt"]) for r in got] == [("b", "2024-02-02"), ("a", "2024-02-02")]
    with pytest.raises(validation.InvalidData):
        catalog.required_sources(sources, ["c"], "2024-02-02")


UNIT = {"showHeroTag": "1", "price": "2", "species": "1|0", "class": "2", "skillName": " Hit ", "skillDesc": "d", "initHP": "500", "initAttackDamage": "50", "attackSpeed": "0.7", "armor": "20", "magicResist": "20", "initMP": "0", "maxMP": "60", "attackRange": "1", "criticalStrikeChance": "25"}
ROW = "STRUCT<id:STRING,name:STRING," + ",".join(f"{k}:STRING" for k in UNIT) + ">"


def test_roster_import_from_feeds(spark, tmp_path):
    data = {"101": {"id": "101", "name": "One", **UNIT}, "102": {"id": "102", "name": "Two", **UNIT, "price": "1"}, "201": {"id": "201", "name": "Guest", **UNIT}, "103": {"id": "103", "name": "Off", **UNIT, "showHeroTag": "0"}}
    (tmp_path / "chess.json").write_text(json.dumps({"version": "1", "season": "S", "setId": "18", "data": data}))
    units = etl.map_rows(feeds.feed(spark, str(tmp_path / "chess.json"), ROW)).drop("key")
    names = lambda *pairs: spark.createDataFrame(list(pairs), "key string, name string")
    heroes = jobs.import_heroes(units, names(("1", "race")), names(("2", "job")), "1.0").collect()
    assert [(h["id"], h["cost"], h["traits"]) for h in heroes] == [("hero-102", 1, ["race", "job"]), ("hero-101", 2, ["race", "job"])]
    assert heroes[0]["stats"]["mana"] == "0/60" and heroes[0]["stats"]["critChance"] == "25%" and heroes[0]["skill"]["name"] == "Hit"
    with pytest.raises(validation.InvalidData):
        jobs.import_heroes(units, names(("9", "race")), names(("2", "job")), "1.0")
    validation.require_counts(units, 4, "id", "name")
    with pytest.raises(validation.InvalidData):
        validation.require_counts(units, 5, "id")


DETAIL = {"line_name": " Comp &amp; Co ", "early_info": "a<br>b", "hero_location": [{"hero_id": "101", "location": "1,2", "chess_type": "hero", "equipment_id": "7,8", "is_carry_hero": True}, {"hero_id": "101", "location": "", "chess_type": "hero", "equipment_id": ""}]}


def lineup_rows(spark, *details):
    rows = [(str(10 + i), "S" if i % 2 == 0 else "A", str(i), "5", "18", "1.0", "S1", ("me",), d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(details)]
    return spark.createDataFrame(rows, "id string, quality string, sortID string, status string, mode string, simulator_edition string, simulator_season string, lineupauthor_data struct<name:string>, detail string")


def test_lineup_import_keeps_repeated_slots(spark):
    feed = etl.published(lineup_rows(spark, DETAIL, DETAIL), "1.0", "s1", lower_season=True)
    assert etl.published(lineup_rows(spark, DETAIL), "1.0", "s1").count() == 0  # compared as it is
    parsed = etl.with_detail(feed, strict=True)
    maps = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in (p[0].lstrip("_"), p[1])])
    done = etl.convert_lineups(parsed, maps(_101="One"), maps(_101="2"), maps(_7="Sword", _8="Bow"), F.array(F.lit("hero-101")))
    etl.require_known(done)
    row = done.orderBy(*[F.col("quality") != "S"]).first()
    assert row["name"] == "Comp & Co" and row["guide"]["early"] == "a\nb" and row["guide"]["reroll"] == ""
    assert [(m["heroId"], m["isCarry"], m["position"] and tuple(m["position"]), [i["name"] for i in m["items"]]) for m in row["members"]] == [("hero-101", True, (1, 2), ["Sword", "Bow"]), ("hero-101", False, None, [])]
    unknown = etl.convert_lineups(parsed, maps(_9="x"), maps(_9="1"), maps(_7="Sword"), F.array(F.lit("hero-101")))
    with pytest.raises(validation.InvalidData):
        etl.require_known(unknown)


def test_bad_detail_is_skipped_or_fatal(spark):
    feed = lineup_rows(spark, DETAIL, "{", {**DETAIL, "line_name": " "})
    assert etl.with_detail(feed, strict=False).count() == 1
    with pytest.raises(validation.InvalidData):
        etl.with_detail(feed, strict=True)
    roster = spark.createDataFrame([("101",)], "id string")
    items = spark.createDataFrame([("7", "Sword"), ("8", "Bow")], "key string, name string")
    slots = jobs.recommendation_slots(etl.with_detail(feed, strict=False), roster, items)
    comps, equipment = etl.greedy_recommendations(slots)
    assert [(r["name"], r["comp_rank"]) for r in comps.collect()] == [("Comp &amp; Co", 1)] and equipment.first()["item_ids"] == ["7", "8"]


def test_latest_version_must_be_one(spark):
    rows = spark.createDataFrame([("18", "S", 1, "a"), ("18", "S", 0, "b"), ("17", "S", 1, "c")], "mode string, season string, is_newest_version int, version string")
    assert etl.latest_version(rows, "18", "S").first()["version"] == "a"
    for bad in (rows.where("version = 'b'"), rows.union(rows)):
        with pytest.raises(validation.InvalidData):
            etl.latest_version(bad, "18", "S")


def test_config_and_history_files(spark, tmp_path):
    (tmp_path / "config.js").write_text("x();\n  var mode = '18';\nvar season=\"S\"\n")
    assert tuple(feeds.config_values(spark, str(tmp_path / "config.js"), "mode", "season", "none").first()) == ("18", "S", None)
    good = {"id": "a", "completedAt": "2024-01-01T00:00:00Z", "seasonId": "s", "patch": "p", "correctCount": 2, "totalQuestions": 20, "score": 10, "winRate": 10.0}
    (tmp_path / "h.json").write_text(json.dumps({"schemaVersion": 1, "records": [good, {"id": "b"}, good]}))
    assert [r["id"] for r in feeds.read_history(spark, str(tmp_path / "h.json")).collect()] == ["a"]
    (tmp_path / "old.json").write_text(json.dumps({"schemaVersion": 9, "records": [good]}))
    (tmp_path / "bad.json").write_text("{")
    for name in ("old.json", "bad.json", "none.json"):
        assert feeds.read_history(spark, str(tmp_path / name)).count() == 0


def test_reports_are_not_overwritten(spark, tmp_path):
    feeds.write_report(spark.range(1), str(tmp_path / "r"))
    with pytest.raises(Exception, match="(?i)exists"):
        feeds.write_report(spark.range(1), str(tmp_path / "r"))
    files = spark.createDataFrame([("b", b"2"), ("a", b"1")], "path string, content binary")
    assert feeds.content_hash(files) == feeds.content_hash(files.orderBy("path")) and len(feeds.content_hash(files)) == 16


LINEUPS = {
    "schemaVersion": 1, "seasonId": "s1", "seasonName": "One", "patch": "1.0", "updatedAt": "2024-01-01", "status": "verified",
    "sources": [{"id": "lineups", "title": "t", "url": "https://x.example", "checkedAt": "2024-01-01"}],
    "lineups": [{
        "id": "official-7", "officialId": "7", "name": "n", "quality": "S", "sortOrder": 3, "author": "", "sourceIds": ["lineups"],
        "members": [{"unitId": "1", "heroId": "hero-1", "name": "One", "cost": 1, "kind": "hero", "isCarry": True, "position": {"row": 1, "column": 7}, "items": []}],
        "guide": dict.fromkeys(("early", "reroll", "position", "matchups", "equipment", "augments", "adventure"), ""),
    }],
}


@pytest.mark.parametrize(
    ("change", "path"),
    [
        (lambda d: None, None),
        (lambda d: d.update(status="unverified"), "status"),
        (lambda d: d["lineups"].append(d["lineups"][0]), "lineups"),
        (lambda d: d["lineups"][0].update(quality="B"), "lineups[0].quality"),
        (lambda d: d["lineups"][0]["members"][0].update(position={"row": 5, "column": 1}), "lineups[0].members[0].position"),
        (lambda d: d["lineups"][0]["members"][0].update(heroId="hero-2"), "lineups[0].members[0].heroId"),
        (lambda d: d["lineups"][0]["members"][0].update(name="Other"), "lineups[0].members[0].heroId"),
        (lambda d: d.update(patch="2.0"), "patch"),
        (lambda d: d["lineups"][0].update(sourceIds=["lineups", "none"]), "lineups[0].sourceIds[1]"),
    ],
)
def test_lineup_rules(spark, tmp_path, change, path):
    from test_operators import CATALOG

    data = json.loads(json.dumps(LINEUPS))
    change(data)
    (tmp_path / "l.json").write_text(json.dumps(data))
    (tmp_path / "c.json").write_text(json.dumps(CATALOG))
    heroes = feeds.json_documents(spark, str(tmp_path / "c.json"), feeds.CATALOG_SCHEMA)
    found = {r["path"] for r in validation.lineup_violations(feeds.json_documents(spark, str(tmp_path / "l.json"), feeds.LINEUP_SCHEMA), heroes).collect()}
    assert found == set() if path is None else path in found


@pytest.mark.parametrize(
    ("change", "path"),
    [
        (lambda m: None, None),
        (lambda m: m.update(datasetKind="synthetic-smoke"), "datasetKind"),
        (lambda m: m["cases"].append({**m["cases"][0]}), "cases.id"),
        (lambda m: m["cases"][0].update(expectedHeroId="hero-9"), "cases[0].expectedHeroId"),
        (lambda m: m["cases"][1].update(expectedHeroId="hero-1"), "cases[1].expectedHeroId"),
        (lambda m: m["cases"][0].update(path="../x.png"), "cases[0].path"),
        (lambda m: m.update(patch="9"), "patch"),
    ],
)
def test_manifest_rules(spark, tmp_path, change, path):
    from test_operators import CATALOG

    data = {"schemaVersion": 1, "datasetKind": "independent", "seasonId": "s1", "patch": "1.0", "cases": [{"id": "a", "category": "game", "sourceId": "s-1", "expectedHeroId": "hero-1", "path": "a.png"}, {"id": "b", "category": "unknown", "sourceId": "s-2", "path": "b.png"}]}
    change(data)
    (tmp_path / "m.json").write_text(json.dumps(data))
    (tmp_path / "c.json").write_text(json.dumps(CATALOG))
    manifest = feeds.json_documents(spark, str(tmp_path / "m.json"), feeds.MANIFEST_SCHEMA)
    heroes = feeds.json_documents(spark, str(tmp_path / "c.json"), feeds.CATALOG_SCHEMA)
    found = {r["path"] for r in validation.manifest_violations(manifest, heroes).collect()}
    assert found == set() if path is None else path in found


def test_lineups_are_imported_whole_or_not_at_all(spark):
    schema = "id string, quality string, sortID string, status string, mode string, simulator_edition string, simulator_season string, lineupauthor_data struct<name:string>, detail string"
    detail = '{"line_name":"L","hero_location":[{"hero_id":"101","location":"%s","chess_type":"hero","equipment_id":"7","is_carry_hero":true}]}'
    row = lambda i, grade, where: (i, grade, "5", etl.PUBLISHED_STATUS, etl.PUBLISHED_MODE, "e", "s", ("N",), detail % where)
    feed = lambda data, kind, v="v1": spark.createDataFrame([(v, "s", "t", data)], f"version string, season string, setId string, data map<string,struct<{kind}>>")
    units, items = feed({"101": ("Ann", "2")}, "name:string,price:string"), feed({"7": ("Sword",)}, "name:string")
    roster = spark.createDataFrame([("hero-101",)], "id string")
    run = lambda rows, units=units: jobs.import_lineups(spark.createDataFrame(rows, schema), units, items, roster, "e", "s", ("v1", "s", "t"))
    got = run([row("2", "A", "1,2"), row("1", "S", "4,7"), row("3", "B", "1,1")]).collect()
    assert [(r["id"], r["members"][0]["heroId"], r["members"][0]["position"].asDict()) for r in got] == [("official-1", "hero-101", {"row": 4, "column": 7}), ("official-2", "hero-101", {"row": 1, "column": 2})]
    with pytest.raises(validation.InvalidData, match="position"):
        run([row("1", "S", "5,1")])
    with pytest.raises(validation.InvalidData, match="another version"):
        run([row("1", "S", "1,1")], feed({"101": ("Ann", "2")}, "name:string,price:string", "v0"))
    with pytest.raises(validation.InvalidData, match="unknown unit"):
        run([row("1", "S", "1,1")], feed({"102": ("Bo", "2")}, "name:string,price:string"))


def test_shown_fallbacks_and_version(spark):
    heroes = spark.createDataFrame([("a", "A", 3, ["x", "y"], ("s", "d")), ("b", "B", None, [], None), ("c", "C", None, None, ("", None))], "id string, name string, cost int, traits array<string>, skill struct<name:string,description:string>")
    got = [tuple(r)[2:] for r in selection.shown(heroes, "-", "none", "?").orderBy("id").collect()]
    assert got == [("3", "x / y", "s", "d"), ("-", "none", "?", "?"), ("-", "none", "?", "?")]
    dated = lambda d: spark.createDataFrame([("p1", d)], "patch string, updatedAt string")
    assert tuple(jobs.content_version(dated("2026-01-02"), dated("2026-02-01")).first()) == ("p1", "2026-02-01")

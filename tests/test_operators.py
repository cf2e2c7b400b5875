"""Operators on literal vectors: order, ties, edges."""

import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import numbers, text
from millrace.operators import catalog, etl, evaluation, history, matching, ordering, quiz, selection, validation, vision
from millrace.plans import jobs
from millrace.sources import archives, feeds
from millrace.streaming import history_stream


def one(spark, column, **values):
    frame = spark.range(1)
    for name, value in values.items():
        frame = frame.withColumn(name, value if hasattr(value, "_jc") else F.lit(value))
    return frame.select(column.alias("v")).first()["v"]


# --- numbers and text


@pytest.mark.parametrize("digits", [1, 3])
def test_fixed_decimals_follow_the_exact_value(spark, digits):
    from decimal import ROUND_HALF_UP, Decimal

    values = [k / 20 for k in range(401)] + [0.15, 1.005, 2.675, 1e-9, 12345.65, -0.25]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", numbers.fixed_decimals(F.col("x"), digits).alias("y")).collect()
    step = Decimal(1).scaleb(-digits)
    assert [r["y"] for r in got] == [float(Decimal(r["x"]).quantize(step, ROUND_HALF_UP)) for r in got]


def test_set_score_guards_what_is_not_finite(spark):
    values = [None, float("nan"), float("inf"), -3.0, 7.9, 25.0]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(numbers.set_score(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in got] == [0, 0, 0, 0, 7, 20]


def test_stride_positions(spark):
    at = lambda s, w, k: one(spark, numbers.stride_positions(F.lit(s), F.lit(w), F.lit(k)))
    assert at(10, 10, 3) == [0] and at(5, 10, 3) == [0] and at(10, 4, 3) == [0, 3, 6] and at(11, 4, 3) == [0, 3, 6, 7]


def test_polygon_and_overlap(spark):
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])
    assert one(spark, numbers.polygon_area(square)) == 4.0
    box = lambda x, w: F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y"), F.lit(float(w)).alias("width"), F.lit(2.0).alias("height"))
    assert one(spark, numbers.box_overlap(box(0, 2), box(1, 2))) == pytest.approx(1 / 3)


@pytest.mark.parametrize(
    ("raw", "plain"),
    [
        ("a<br/>b<br >c<b>d</b>", "a\nb\ncd"),
        ("&amp;#65; &amp;lt; &LT;", "A &lt; <"),
        ("&#x41;&#66;&#0;&#xD800;&#x110000;", "AB&#0;&#xD800;&#x110000;"),
        ("a\r\nb\rc\u00a0 ", "a\nb\nc"),
        (None, ""),
    ],
)
def test_plain_text(spark, raw, plain):
    got = spark.createDataFrame([(raw,)], "x string").select(text.plain_text(F.col("x")).alias("y")).first()["y"]
    assert got == plain


def test_plain_text_stays_in_the_jvm(spark):
    raw = ["&#x1F600;&#65279;x&#0000000000000000000065;", "&#99999999999999999999;&#x;&#;&#1114111;&#1114112;", "&#57343;a&amp;#x41;&#65", "&#38;lt;", "&#" + "0" * 5000 + "65;"]
    frame = spark.createDataFrame([(x,) for x in raw], "x string").select(text.plain_text(F.col("x")).alias("y"))
    assert [r["y"] for r in frame.collect()] == ["\U0001f600\ufeffxA", "&#99999999999999999999;&#x;&#;\U0010ffff&#1114112;", "&#57343;aA&#65", "&lt;", "A"]
    assert "EvalPython" not in frame._jdf.queryExecution().executedPlan().toString()


def test_names_are_looked_for_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), spark.sparkContext.accumulator(0)
    spark.conf.set(key, "10000")
    try:
        docs = spark.range(300).select(F.col("id").alias("doc_id"), text.ocr_lines(F.concat(F.lit("a name "), "id")).alias("text")).coalesce(1)
        assert matching.names_in_lines(docs, spark.createDataFrame([(1, "aname")], "name_id long, name string")).count() == 300
        assert int(spark.conf.get(key)) <= 128
        batch = F.pandas_udf(lambda x: seen.add(int(x.notna().sum())) or x, "string")
        monkeypatch.setattr(text, "_mapped", lambda x, rule: batch(x))
        assert [r["y"] for r in spark.createDataFrame([("plain",), ("é",)], "x string").select(text.ocr_lines(F.col("x")).alias("y")).collect()] == ["plain", "é"]
        assert seen.value == 1  # only what is not ASCII goes through Python
    finally:
        spark.conf.set(key, before)


def test_dates_and_stamps(spark):
    values = ["2024-02-29", "2024-02-31", "tomorrow", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00.5+02:00", " 2024-01-01T00:00:00Z ", None]
    got = spark.createDataFrame([(v,) for v in values], "x string").select(text.is_day(F.col("x")).alias("d"), text.stamp(F.col("x")).isNotNull().alias("s")).collect()
    assert [r["d"] for r in got] == [True, False, False, False, False, False, False]
    assert [r["s"] for r in got] == [False, False, False, True, True, True, False]


def test_paths(spark):
    safe = ["a/b.png", "a/", "x"]
    unsafe = ["", "/a", "a//b", "../a", "a/./b", "a\\b", "C:/a", "a\x01b", None]
    got = spark.createDataFrame([(v,) for v in safe + unsafe], "x string").select(text.safe_entry_path(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in got] == [True] * len(safe) + [False] * len(unsafe)
    assert one(spark, text.safe_image_path(F.lit("assets/a.PNG"))) and not one(spark, text.safe_image_path(F.lit("  https://x/a.png")))


def test_ocr_line_folds_width_and_signs(spark):
    assert one(spark, text.ocr_line(F.lit("  Ａb，c！ 龙\u3000王 "))) == "abc龙王"


def test_image_mime(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"0" * 8
    rows = [(png, "a.png"), (png, "a.jpg"), (b"\xff\xd8\xff\xe0" + b"0" * 9, "b.JPEG"), (b"RIFF0000WEBP", "c.webp"), (b"", "d.png")]
    got = spark.createDataFrame(rows, "c binary, p string").select(text.image_mime(F.col("c"), F.col("p")).alias("m")).collect()
    assert [r["m"] for r in got] == ["image/png", None, "image/jpeg", "image/webp", None]


# --- ordering, histories


def record(i, key, correct, **other):
    base = {"id": key, "completedAt": f"2024-01-0{i + 1}T00:00:00Z", "seasonId": "s", "patch": "p", "correctCount": correct, "totalQuestions": 20, "score": correct * 5, "winRate": correct * 5.0, "ordinal": i}
    return {**base, **other}


def frame(spark, rows):
    return spark.createDataFrame(rows, f"{history.RECORD_SCHEMA}, ordinal long")


def test_history_first_wins_bad_rows_go(spark):
    rows = [record(0, "a", 13), record(1, "a", 20), record(2, "b", 12), record(3, " ", 1), record(4, "c", 3, score=16), record(5, "d", 21), record(6, "e", 1, completedAt="2024-02-31T00:00:00Z")]
    valid = history.valid_records(frame(spark, rows))
    assert [(r["id"], r["score"], r["winRate"]) for r in history.in_order(valid).collect()] == [("a", 65, 65.0), ("b", 60, 60.0)]


def test_history_summary(spark):
    valid = history.valid_records(frame(spark, [record(0, "a", 0), record(1, "b", 12), record(2, "c", 20)]))
    s = history.summary(valid).first()
    assert (s["completed_sets"], s["total_correct"], s["total_questions"], s["best_score"]) == (3, 32, 60, 100)
    assert s["win_rate"] == pytest.approx(32 / 60 * 100)
    empty = history.summary(valid.limit(0)).first()
    assert list(empty) == [0, 0, 0, 0.0, 0]


def test_save_is_idempotent_and_merge_takes_the_last(spark):
    old, new = frame(spark, [record(0, "a", 1)]), frame(spark, [record(1, "a", 2), record(2, "b", 3)])
    saved = history.save(old, new)
    assert {r["id"]: r["correctCount"] for r in saved.collect()} == {"a": 1, "b": 3}
    assert {r["id"]: r["correctCount"] for r in history.save(saved, new).collect()} == {"a": 1, "b": 3}
    assert {r["id"]: r["correctCount"] for r in history.merge_last_wins([old, new]).collect()} == {"a": 2, "b": 3}


def test_recent_keeps_short_lists_whole(spark):
    rows = spark.createDataFrame([("x", i) for i in range(3)] + [("y", i) for i in range(12)], "k string, i int")
    got = ordering.recent(rows, "k", 10, "i").collect()
    assert sorted((r["k"], r["ordinal"]) for r in got) == [("x", i) for i in (1, 2, 3)] + [("y", i) for i in range(3, 13)]


def test_best_first_wins_on_ties(spark):
    rows = spark.createDataFrame([("k", 1.0, 2, "late"), ("k", 1.0, 1, "early"), ("k", 0.5, 0, "low")], "k string, s double, o int, v string")
    assert ordering.best_first_wins(rows, "k", "s", "o", "v").first()["v"] == "early"


def test_stream_ingest_is_idempotent(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps(record(i, k, c)) for i, k, c in ((0, "a", 1), (1, "b", 2), (2, "a", 9))))
    for n in (1, 2):
        history_stream.ingest(history_stream.record_stream(spark, str(source)), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination(120)
        (source / f"again{n}.json").write_text(json.dumps(record(3, "b", 7)))
    stored = history_stream.stored_history(spark, str(tmp_path / "store"))
    assert {r["id"]: r["correctCount"] for r in stored.collect()} == {"a": 1, "b": 2}


# --- selection, layout, greedy


MEMBER = "array<struct<heroId:string,name:string,kind:string,isCarry:boolean>>"


def test_selection_order_and_alternate_forms(spark):
    m = lambda hero, name, kind, carry: (hero, name, kind, carry)
    rows = [
        ("a-low", "A", 1, [m("h1", "x", "hero", False)], 0), ("s-low", "S", 1, [m(None, "Alt", "hero", False)], 1), ("b", "B", 9, [m("h1", "x", "hero", True)], 2),
        ("a-high", "A", 5, [m("h1", "x", "hero", True)], 3), ("s-high", "S", 5, [m(None, "Alt", "pet", True)], 4), ("s-tie", "S", 1, [m("h1", "x", "hero", False), m("h1", "x", "hero", False)], 5),
    ]
    lineups = spark.createDataFrame(rows, f"id string, quality string, sortOrder long, members {MEMBER}, ordinal long")
    assert [r["id"] for r in selection.select_lineups(lineups).collect()] == ["s-high", "s-low", "s-tie", "a-high", "a-low"]
    assert [r["id"] for r in selection.select_lineups(lineups, "h1", "Alt").collect()] == ["a-high", "s-low", "s-tie", "a-low"]
    heroes = spark.createDataFrame([("h1", "Alt"), ("h2", "None")], "id string, name string")
    assert {r["id"]: r["lineups"] for r in selection.lineups_per_hero(heroes, lineups).collect()} == {"h1": 4, "h2": 0}


def test_layout_keeps_every_member(spark):
    rows = [(i, f"m{i}", p) for i, p in enumerate([(1, 1), (4, 7), (1, 1), None, (0, 3), (5, 1), (2, 8), (3, None)])]
    members = spark.createDataFrame(rows, "ordinal long, name string, position struct<row:int,column:int>")
    cells, unplaced = selection.layout(members, spark)
    cells = cells.collect()
    assert len(cells) == 28 and cells[0]["members"] == ["m0", "m2"] and cells[27]["members"] == ["m1"]
    assert sum(len(c["members"]) for c in cells) + unplaced.count() == len(rows)


def simulate(slots):
    comps, items, seen = {}, {}, set()
    for rank, _, hero, name, ids, known in sorted(slots, key=lambda s: (s[0], s[1])):
        if (rank, hero) in seen:
            continue
        seen.add((rank, hero))
        mine = comps.setdefault(hero, [])
        if len(mine) >= 3 or name in mine:
            continue
        mine.append(name.strip())
        if hero not in items and ids and known:
            items[hero] = ids
    return comps, items


def test_greedy_equals_the_walk(spark):
    rng = np.random.default_rng(5)
    slots = [(r, s, f"h{rng.integers(6)}", " " * int(rng.integers(2)) + f"c{rng.integers(5)}", [f"i{rng.integers(9)}"] * int(rng.integers(2)), bool(rng.integers(2))) for r in range(60) for s in range(6)]
    names = {}
    slots = [(r, s, h, names.setdefault(r, n), i, k) for r, s, h, n, i, k in slots]
    rows = spark.createDataFrame(slots, "lineup_rank int, slot int, hero string, line_name string, item_ids array<string>, items_known boolean")
    comps, items = etl.greedy_recommendations(rows)
    got = {}
    for r in comps.orderBy("comp_rank").collect():
        got.setdefault(r["hero"], []).append(r["name"])
    want, equipment = simulate(slots)
    assert got == want
    assert {r["hero"]: r["item_ids"] for r in items.collect()} == equipment


def test_ordered_names(spark):
    names = F.create_map(F.lit("1"), F.lit("a"), F.lit("2"), F.lit("b"))
    assert one(spark, catalog.ordered_names(F.lit("2|0|1|-1||2|9"), names)) == ["b", "a", None]


def test_quiz_properties(spark):
    for count in (1, 2, 5, 30):
        heroes = spark.createDataFrame([(f"h{i}", f"n{i}", [("card", "card"), ("splash", "splash")], i) for i in range(count)], "id string, name string, variants array<struct<id:string,kind:string>>, ordinal int")
        images = spark.createDataFrame([(f"h{i}", v, b"x", k) for i in range(count) for k, v in enumerate(("splash", "card"))], "heroId string, variantId string, content binary, imageOrdinal int")
        asked = quiz.questions(heroes, images, 3).collect()
        again = quiz.questions(heroes, images, 3).collect()
        assert asked == again
        if count < 2:
            assert asked == []
            continue
        ids = [r["heroId"] for r in asked]
        assert len(ids) == 20 and all(a != b for a, b in zip(ids, ids[1:]))
        assert all(r["variantId"] == "card" and len({o["name"] for o in r["options"]}) == min(4, count) and r["heroId"] in [o["heroId"] for o in r["options"]] for r in asked)


def test_with_precedence(spark):
    a, b = spark.createDataFrame([(1, "l")], "k int, v string"), spark.createDataFrame([(1, "p"), (2, "p")], "k int, v string")
    assert sorted((r["k"], r["v"]) for r in catalog.with_precedence(a, b, ["k"]).collect()) == [(1, "l"), (2, "p")]
    with pytest.raises(validation.InvalidData):
        catalog.inner_or_raise(b, a.select("k"), ["k"], "row")


# --- evaluation


def test_evaluation_summary(spark):
    rows = [("game", "a", "a", "match", 10.0, 2.0), ("game", "b", None, "uncertain", 20.0, 3.0), ("splash", "a", "b", "match", 40.0, 4.0), ("unknown", None, None, "match", 15.0, 2.0), ("unknown", None, None, "uncertain", 25.0, float("nan"))]
    data = spark.createDataFrame(rows, "category string, expected string, predicted string, status string, recognition_ms double, decode_ms double")
    got = {r["category"]: r for r in evaluation.summarize(data).collect()}
    assert got["game"]["top1_rate"] == 0.5 and got["game"]["recognition_ms_median"] == 10 and got["splash"]["wrong_decisions"] == 1
    assert got["unknown"]["false_positive_rate"] == 0.5 and got["unknown"]["recognition_ms_p95"] == 25 and got["unknown"]["decode_ms_max"] == 2
    empty = {r["category"]: r for r in evaluation.summarize(data.limit(0)).collect()}
    assert len(empty) == 3 and empty["game"]["n"] == 0 and empty["game"]["top1_rate"] is None and empty["game"]["recognition_ms_max"] is None


# --- rules and sources


CATALOG = {
    "schemaVersion": 1, "seasonId": "s1", "seasonName": "One", "patch": "1.0", "updatedAt": "2024-01-01", "status": "verified",
    "sources": [{"id": "heroes", "title": "t", "url": "https://x.example", "checkedAt": "2024-01-01"}],
    "heroes": [{
        "id": "hero-1", "name": "One", "cost": 1, "traits": ["a"], "skill": {"name": "s", "description": "d"}, "stats": {"hp": "100", "mana": "0/50"},
        "recommendations": {"patch": "1.0", "items": [], "comps": [], "sourceIds": ["heroes"]}, "variants": [{"id": "card", "kind": "card"}],
    }],
}


def catalog_frame(spark, tmp_path, change=None, name="c.json"):
    data = json.loads(json.dumps(CATALOG))
    if change:
        change(data)
    path = tmp_path / name
    path.write_text(json.dumps(data))
    return feeds.json_documents(spark, str(path), feeds.CATALOG_SCHEMA)


@pytest.mark.parametrize(
    ("change", "path"),
    [
        (lambda c: None, None),
        (lambda c: c["heroes"][0]["recommendations"].update(patch="0.9"), "heroes[0].recommendations.patch"),
        (lambda c: c["heroes"].append(c["heroes"][0]), "heroes"),
        (lambda c: c.update(sources=[]), "sources"),
        (lambda c: c["heroes"][0]["variants"][0].update(url="  https://evil/a.png"), "heroes[0].variants"),
        (lambda c: c["heroes"][0].update(cost=1.5), "heroes[0].cost"),
        (lambda c: c["heroes"][0]["stats"].update(hp="-1"), "heroes[0].stats"),
        (lambda c: c.update(updatedAt="tomorrow"), "updatedAt"),
        (lambda c: c["heroes"][0]["recommendations"].update(sourceIds=["none"]), "heroes[0].recommendations.sourceIds[0]"),
    ],
)
def test_catalog_rules(spark, tmp_path, change, path):
    found = {r["path"] for r in validation.catalog_violations(catalog_frame(spark, tmp_path, change)).collect()}
    assert found == set() if path is None else path in found


def test_fallback_on_invalid_and_unverified(spark, tmp_path):
    good = lambda: catalog_frame(spark, tmp_path, None, "good.json")
    bad = lambda: catalog_frame(spark, tmp_path, lambda c: c.update(patch=""), "bad.json")
    open_ = lambda: catalog_frame(spark, tmp_path, lambda c: c.update(status="unverified", seasonName="Built in"), "open.json")
    none = lambda: feeds.json_documents(spark, str(tmp_path / "none.json"), feeds.CATALOG_SCHEMA)
    check = validation.catalog_violations
    name = lambda f: f.head()["seasonName"]
    assert name(feeds.with_fallback(good, bad, check)) == "One"
    assert name(feeds.with_fallback(bad, good, check)) == "One"
    assert name(feeds.with_fallback(open_, good, check)) == "One"
    assert name(feeds.with_fallback(open_, none, check)) == "Built in"
    with pytest.raises(validation.InvalidData):
        feeds.with_fallback(bad, none, check)


PNG = b"\x89PNG\r\n\x1a\n" + b"0" * 40


def pack(references=None, files=None, **manifest):
    data = {"schemaVersion": 1, "seasonId": "s1", "patch": "1.0", "catalog": CATALOG, "references": references or [{"heroId": "hero-1", "variantId": "card", "path": "a.png"}], **manifest}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps(data))
        for name, content in (files or {"a.png": PNG}).items():
            z.writestr(name, content)
    return buffer.getvalue()


def test_pack_loads_and_rejects(spark, tmp_path):
    good = tmp_path / "good.zip"
    good.write_bytes(pack())
    _, records = jobs.load_pack(spark, str(good))
    assert [(r["key"], r["mime"]) for r in records.collect()] == [("hero-1/card", "image/png")]
    for i, data in enumerate((pack(patch="2.0"), pack([{"heroId": "hero-9", "variantId": "card", "path": "a.png"}]), pack(files={"a.png": b"no image"}), pack(files={"b.png": PNG}), b"no archive")):
        bad = tmp_path / f"bad{i}.zip"
        bad.write_bytes(data)
        with pytest.raises(validation.InvalidData):
            jobs.load_pack(spark, str(bad))


def test_archive_checks():
    data = archives.write_stored([("a/b.txt", b"x" * 100), ("c", b"")])
    assert archives.read_entries(data) == {"a/b.txt": b"x" * 100, "c": b""}
    at = data.index(b"x" * 100)
    bad = [data[:at] + b"y" + data[at + 1 :], data[:-1], data.replace(b"a/b.txt", b"../.txt"), data.replace(b"a/b.txt", b"a/b.txu", 1), data[:8] + struct.pack("<H", 9) + data[10:]]
    for broken in bad:
        with pytest.raises(archives.BadArchive):
            archives.read_entries(broken)
    with pytest.raises(archives.BadArchive):
        archives.read_entries(data, archives.Limits(entries=1))
    with pytest.raises(archives.BadArchive):
        archives.read_entries(data, archives.Limits(total_bytes=50))


def test_versions_replace_together(spark, tmp_path):
    root = str(tmp_path / "store")
    feeds.replace_tables({"a": spark.range(2), "b": spark.range(3)}, root)
    feeds.replace_tables({"a": spark.range(5), "b": spark.range(6)}, root)
    assert feeds.current_table(spark, root, "a").count() == 5 and feeds.current_table(spark, root, "b").count() == 6
    feeds.clear_tables(spark, root, {"a": "id long"})
    assert feeds.current_table(spark, root, "a").count() == 0


# --- images


def painted(seed, width=64, height=80):
    rng = np.random.default_rng(seed)
    cells = rng.integers(0, 255, (5, 4, 4), dtype=np.uint8)
    image = np.kron(cells, np.ones((height // 5, width // 4, 1), np.uint8)).astype(np.uint8)
    image[..., 3] = 255
    return image


def test_signature_and_similarity(spark):
    rows = [(i, 64, 80, painted(i).tobytes()) for i in range(4)] + [(9, 64, 80, b"short"), (10, 64, 80, bytes(64 * 80 * 4))]
    made = vision.signatures(spark.createDataFrame(rows, "id long, width int, height int, rgba binary"))
    assert made.where("id = 9").first()["signature"]["hash"] is None
    assert {r["id"] for r in vision.usable(made).collect()} == {0, 1, 2, 3}
    assert all(bin(r["signature"]["hash"]).count("1") <= 31 for r in vision.usable(made).collect())
    a, b = made.where("id < 4").alias("a"), made.where("id < 4").alias("b")
    scores = a.crossJoin(b).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), vision.similarity(F.col("a.signature"), F.col("b.signature")).alias("s")).collect()
    assert all((r["s"] == pytest.approx(1.0)) == (r["x"] == r["y"]) for r in scores)


def test_recognition_finds_the_embedded_card(spark):
    photo = np.full((200, 220, 4), 40, np.uint8)
    photo[60:140, 90:154] = painted(1)
    references = spark.createDataFrame([(f"h{i}", "card", i, 64, 80, painted(i).tobytes()) for i in range(3)], "heroId string, variantId string, ordinal long, width int, height int, rgba binary")
    images = spark.createDataFrame([("exact", 64, 80, painted(2).tobytes()), ("photo", 220, 200, photo.tobytes()), ("bad", 5, 5, b"")], "id string, width int, height int, rgba binary")
    got = {r["case"]: r for r in jobs.recognize(images, references).collect()}
    assert got["exact"]["status"] == "match" and got["exact"]["matches"][0]["heroId"] == "h2"
    assert got["photo"]["matches"] is None or got["photo"]["matches"] == [] or got["photo"]["matches"][0]["heroId"] == "h1"
    assert (got["bad"]["status"], got["bad"]["reason"], got["bad"]["matches"]) == ("unavailable", "image_decode_failed", None)
    best = got["exact"]["matches"][0]
    assert best["box"].asDict() == {"x": 0, "y": 0, "width": 64, "height": 80} and best["evidence"].asDict() == {"method": "phash", "variantId": "card"}


def test_a_card_between_strides_is_found_at_its_place(spark):
    photo = np.full((230, 260, 4), 40, np.uint8)
    photo[83:163, 101:165] = painted(1)
    references = spark.createDataFrame([(f"h{i}", "card", i, 64, 80, painted(i).tobytes()) for i in range(3)], "heroId string, variantId string, ordinal long, width int, height int, rgba binary")
    images = spark.createDataFrame([("photo", 260, 230, photo.tobytes())], "id string, width int, height int, rgba binary")
    first = jobs.recognize(images, references).first()["matches"][0]
    assert first["heroId"] == "h1" and first["score"] > 0.95
    assert all(abs(first["box"][k] - v) <= 4 for k, v in {"x": 101, "y": 83, "width": 64, "height": 80}.items())


def test_nothing_to_compare_with_is_unavailable(spark):
    schema = "heroId string, variantId string, ordinal long, width int, height int, rgba binary"
    images = spark.createDataFrame([("a", 64, 80, painted(2).tobytes()), ("b", None, 80, b"")], "id string, width int, height int, rgba binary")
    flat = np.full((80, 64, 4), 9, np.uint8).tobytes()
    for rows, reasons in (([], {"a": "no_references", "b": "no_references"}), ([("h", "card", 0, 64, 80, flat)], {"a": "no_usable_references", "b": "image_decode_failed"})):
        got = jobs.recognize(images, spark.createDataFrame(rows, schema)).collect()
        assert {r["case"]: r["reason"] for r in got} == reasons and all(r["status"] == "unavailable" and r["matches"] is None for r in got)


def test_best_windows_equal_all_comparisons(spark):
    rng = np.random.default_rng(4)
    sign = lambda n: [(int(rng.integers(1 << 62)), [float(v) for v in rng.integers(0, 255, 48)], 20.0) for _ in range(n)]
    kind = f"signature struct<{vision.SIGNATURE.replace(' ', ':').replace(',:', ',')}>"
    windows = [("c", 1, k, k, 0, 20, 20, s) for k, s in enumerate(sign(60))]
    windows += [("c", 1, 60, 60, 0, 20, 20, windows[7][-1])]
    refs = [(k, f"h{k}", "card", 1, 1.0, s) for k, s in enumerate([*sign(4), windows[7][-1]])]
    got = vision.best_windows(
        spark.createDataFrame(windows, f"case string, aspect_bucket int, seen int, x int, y int, width int, height int, {kind}"),
        spark.createDataFrame(refs, f"ordinal long, heroId string, variantId string, aspect_bucket int, aspect double, {kind}"),
    ).collect()

    def plain(a, b):
        return 0.78 * (1 - (a[0] ^ b[0]).bit_count() / 63) + 0.22 * (1 - sum(abs(x - y) for x, y in zip(a[1], b[1])) / (48 * 255))

    want = {r[0]: max(((plain(w[-1], r[-1]), -w[2]) for w in windows)) for r in refs}
    assert {r["ordinal"]: r["box"]["x"] for r in got} == {k: -seen for k, (_, seen) in want.items()}
    assert all(r["score"] == pytest.approx(want[r["ordinal"]][0], abs=1e-9) for r in got)


def test_window_sizes():
    for width, height, aspect in ((960, 540, 0.78), (64, 80, 0.8), (300, 90, 1.9), (50, 40, 1.0), (960, 700, 1.13**3)):
        sizes = vision.window_sizes(width, height, aspect)
        assert len(sizes) == len(set(sizes)) and all(16 <= w <= width and 16 <= h <= height for w, h in sizes)
        least = max(48, int(np.ceil(48 * aspect)), int(min(width, height) * 0.07))
        widest = int(min(width, height * aspect))
        if widest >= least:
            assert widest in [w for w, _ in sizes] and sizes[0][0] == least


def test_equal_scores_keep_the_input_order(spark):
    rows = [("c", "a", 0.9, 3), ("c", "z", 0.9, 1), ("c", "m", 0.9, 2), ("c", "b", 0.8, 0)]
    data = spark.createDataFrame(rows, "case string, heroId string, score double, ordinal long").withColumn("method", F.lit("phash"))
    assert [m["heroId"] for m in vision.decide(data, ["case"]).first()["matches"]] == ["z", "m", "a"]
    assert vision.decide(data, ["case"], margins=(0.0, 0.0)).first()["status"] == "match"


def test_ties_of_recognised_cases_are_named(spark):
    box = (1, 2, 50, 60)
    kind = "array<struct<score:double,heroId:string,method:string,box:struct<x:int,y:int,width:int,height:int>,evidence:struct<method:string,variantId:string>>>"
    rows = [(c, "uncertain", "insufficient_evidence", [(0.95, "a", "phash", box, ("phash", "card")), (0.93, "b", "phash", box, ("phash", "card"))]) for c in ("t", "u")] + [("n", "unavailable", "no_references", None)]
    results = spark.createDataFrame(rows, f"case string, status string, reason string, matches {kind}")
    heroes = spark.createDataFrame([("a", "山神", None), ("b", "龙王", ["水龙"])], "id string, name string, aliases array<string>")
    ocr = spark.createDataFrame([("t", "ok", "水龙", 80.0), ("u", "ok", "水龙", 60.0)], "case string, status string, text string, confidence double")
    got = {r["case"]: (r["status"], r["reason"], [m["heroId"] for m in r["matches"] or []]) for r in jobs.name_tied(results, heroes, ocr).collect()}
    assert got == {"t": ("match", "ocr_tiebreak", ["b", "a"]), "u": ("uncertain", "insufficient_evidence", ["a", "b"]), "n": ("unavailable", "no_references", [])}


def test_a_broken_store_is_an_error_and_not_an_empty_history(spark, tmp_path):
    store = str(tmp_path / "store")
    assert history_stream.stored_history(spark, store).count() == 0
    spark.createDataFrame([(0, f"{store}/lost")], "batch long, path string").write.parquet(f"{store}/versions")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        history_stream.stored_history(spark, store).collect()


def test_a_failed_writer_leaves_the_version_in_force(spark, tmp_path):
    root = str(tmp_path / "root")
    feeds.replace_tables({"a": spark.range(2)}, root)
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        feeds.replace_tables({"a": spark.range(9), "b": broken}, root)
    assert feeds.current_table(spark, root, "a").count() == 2


def test_decision_margin_counts_runner_up_below_the_floor(spark):
    rows = [("sure", "a", 0.95), ("sure", "b", 0.6), ("close", "a", 0.95), ("close", "b", 0.92), ("weak", "a", 0.8)]
    data = spark.createDataFrame(rows, "case string, heroId string, score double").withColumn("method", F.lit("phash"))
    got = {r["case"]: r for r in vision.decide(data, ["case"]).collect()}
    assert {k: v["status"] for k, v in got.items()} == {"sure": "match", "close": "uncertain", "weak": "uncertain"}
    assert [m["heroId"] for m in got["sure"]["matches"]] == ["a"]


def test_best_per_hero_compares_with_the_rounded_score(spark):
    rows = [("c", "h", 0, 0.90004, "first"), ("c", "h", 1, 0.90003, "second")]
    data = spark.createDataFrame(rows, "case string, heroId string, ordinal long, score double, variantId string")
    assert vision.best_per_hero(data, ["case"]).first()["variantId"] == "second"  # above 0.9000


def test_ocr_tie_break(spark):
    match = "struct<heroId:string,score:double,box:struct<x:double,y:double,width:double,height:double>,evidence:struct<method:string>>"
    box = (10.0, 10.0, 50.0, 60.0)
    rows = [("t", "uncertain", "insufficient_evidence", False, [("a", 0.95, box, ("phash",)), ("b", 0.93, box, ("phash",))]), ("far", "uncertain", "x", False, [("a", 0.95, box, ("phash",)), ("b", 0.93, (500.0, 0.0, 5.0, 5.0), ("phash",))])]
    results = spark.createDataFrame(rows, f"case string, status string, reason string, orb_available boolean, matches array<{match}>")
    ocr = spark.createDataFrame([(c, "ok", "xx 龙 王 yy\nother", 80.0) for c in ("t", "far")], "case string, status string, text string, confidence double")
    named = spark.createDataFrame([(c, h, n, None) for c in ("t", "far") for h, n in (("a", "山神"), ("b", "龙王"))], "case string, heroId string, name string, aliases array<string>")
    hits = vision.named_candidate(ocr, named, 75.0)
    got = {r["case"]: r for r in vision.break_ties(results, hits).collect()}
    assert got["t"]["status"] == "match" and [m["heroId"] for m in got["t"]["matches"]] == ["b", "a"] and got["t"]["matches"][0]["score"] == 0.93
    assert got["far"]["status"] == "uncertain"


def test_prefix_sums_and_wraparound(spark):
    grid = spark.createDataFrame([(y, x, y * 3 + x) for y in range(3) for x in range(3)], "y int, x int, v int")
    got = {(r["y"], r["x"]): r["v"] for r in ordering.prefix_sums(grid, "y", "x", ["v"]).collect()}
    want = np.arange(9).reshape(3, 3).cumsum(0).cumsum(1)
    assert all(got[y, x] == want[y, x] for y in range(3) for x in range(3))


def test_descriptors_use_each_train_row_once(spark):
    q = spark.createDataFrame([("g", 0, [0]), ("g", 1, [1])], "group string, q int, q_words array<long>")
    t = spark.createDataFrame([("g", 0, [0]), ("g", 1, [(1 << 40) - 1])], "group string, t int, t_words array<long>")
    assert [(r["q"], r["t"]) for r in vision.nearest_descriptors(q, t).collect()] == [(0, 0)]


def test_rules_give_paths_and_raise(spark):
    rows = spark.createDataFrame([(1, -1), (2, None), (3, 5)], "id int, v int")
    found = validation.violations(rows, [(F.col("v") >= 0, F.concat(F.lit("r"), F.col("id").cast("string")), "negative")])
    assert {r["path"] for r in found.collect()} == {"r1", "r2"}
    with pytest.raises(validation.InvalidData, match="r1"):
        validation.require_valid(found)

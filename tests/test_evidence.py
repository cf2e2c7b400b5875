"""What matches tell of how they were found, and the bounds of what is read."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import catalog, validation, vision
from millrace.plans import jobs
from millrace.sources import feeds

IMAGE = "width int, height int, rgba binary"


def picture(seed, height=80, width=64):
    rng = np.random.default_rng(seed)
    rough = rng.integers(0, 256, (8, 8, 4)).astype(np.uint8).repeat(height // 8, 0).repeat(width // 8, 1)
    rough[..., 3] = 255
    return rough


def test_matches_carry_their_distances(spark):
    a, b = picture(1), picture(2)
    scene = np.full((200, 240, 4), 120, np.uint8)
    scene[40:120, 70:134] = a
    images = spark.createDataFrame([("whole", 64, 80, a.tobytes()), ("scene", 240, 200, scene.tobytes())], f"id string, {IMAGE}")
    references = spark.createDataFrame([("ha", "card", 0, 64, 80, a.tobytes()), ("hb", "card", 1, 64, 80, b.tobytes())], f"heroId string, variantId string, ordinal long, {IMAGE}")
    got = {r["case"]: r["matches"][0] for r in jobs.recognize(images, references).collect()}
    assert got["whole"]["heroId"] == "ha" and got["whole"]["hashDistance"] == 0 and got["whole"]["colorScore"] == 1.0
    for m in got.values():
        assert 0 <= m["hashDistance"] <= 63 and m["colorScore"] == round(m["colorScore"], 3)
        assert m["score"] == pytest.approx(0.78 * (1 - m["hashDistance"] / 63) + 0.22 * m["colorScore"], abs=2e-3)


def test_windows_are_scanned_once(spark):
    a = picture(1)
    images = spark.createDataFrame([("whole", 64, 80, a.tobytes())], f"id string, {IMAGE}")
    references = spark.createDataFrame([("ha", "card", 0, 64, 80, a.tobytes())], f"heroId string, variantId string, ordinal long, {IMAGE}")
    plan = jobs.recognize(images, references)._jdf.queryExecution().optimizedPlan().toString()
    kept = plan.split("InMemoryRelation")[0]  # what is written once, by checkpoint or on disks, is not made again
    assert "scan(" not in kept and "made(" not in kept


def test_promoted_matches_tell_what_was_read(spark):
    box = (1, 2, 50, 60)
    kind = "array<struct<score:double,heroId:string,method:string,box:struct<x:int,y:int,width:int,height:int>,evidence:struct<method:string,variantId:string>>>"
    results = spark.createDataFrame([("t", "uncertain", "insufficient_evidence", [(0.95, "a", "phash", box, ("phash", "card")), (0.93, "b", "phash", box, ("phash", "card"))])], f"case string, status string, reason string, matches {kind}")
    heroes = spark.createDataFrame([("a", "山神", None), ("b", "龙王", ["水龙"])], "id string, name string, aliases array<string>")
    ocr = spark.createDataFrame([("t", "ok", "水 龙!", 180.0)], "case string, status string, text string, confidence double")
    first, second = jobs.name_tied(results, heroes, ocr).first()["matches"]
    assert (first["heroId"], first["score"], first["visualScore"], first["visualRank"]) == ("b", 0.93, 0.93, 2)
    assert first["ocr"].asDict() == {"method": "ocr_name", "matchedName": "水龙", "confidence": 100.0}
    assert second["heroId"] == "a" and second["visualScore"] is None and second["visualRank"] is None and second["ocr"] is None


def test_confidence_and_tie_thresholds(spark):
    values = [(None, 0.0), (-3.0, 0.0), (41.5, 41.5), (1e9, 100.0), (float("nan"), 0.0), (float("inf"), 0.0)]
    rows = spark.createDataFrame(values, "x double, want double").withColumn("got", vision.clamped_confidence(F.col("x"))).collect()
    assert all(r["got"] == r["want"] for r in rows)
    m = "array<struct<score:double,evidence:struct<method:string>>>"
    tied = spark.createDataFrame([("uncertain", [(0.8, ("phash",)), (0.79, ("phash",))], False)], f"status string, matches {m}, orb boolean")
    ask = lambda **k: tied.select(vision.tie_eligible(F.col("status"), F.col("matches"), F.col("orb"), **k).alias("t")).first()["t"]
    assert not ask() and ask(thresholds=(0.7, 0.7, 0.7)) and not ask(thresholds=(0.7, 0.7, 0.7), most_gap=0.001)


def test_manifests_have_a_bound(spark, tmp_path):
    small, large = tmp_path / "small.json", tmp_path / "large.json"
    small.write_text(json.dumps({"schemaVersion": 1, "cases": []}))
    large.write_text(json.dumps({"schemaVersion": 1, "cases": [], "patch": "x" * feeds.MANIFEST_BYTES}))
    assert feeds.case_manifest(spark, str(small)).first()["schemaVersion"] == 1
    with pytest.raises(validation.InvalidData, match="1 MB"):
        feeds.case_manifest(spark, str(large))


def test_references_counts_and_pieces(spark):
    heroes = spark.createDataFrame([("h1",), ("h2",)], "id string")
    variants = spark.createDataFrame([("h1", "card"), ("h2", "splash")], "heroId string, variantId string")
    stored = spark.createDataFrame([("h1/card", 1), ("h1/splash", 2), ("h3/card", 3), (None, 4)], "key string, n int")
    assert [r["n"] for r in catalog.of_catalogue(stored, variants).collect()] == [1]
    meta = spark.createDataFrame([("s", "p", 7)], "seasonId string, patch string, referenceCount int")
    assert tuple(catalog.library_counts(heroes, stored, meta).first()) == (2, 4, 7, True)
    assert tuple(catalog.library_counts(heroes.limit(0), stored.limit(0), meta.limit(0)).first()) == (0, 0, 0, False)
    rows = spark.createDataFrame([("山神", "a.b/C.PNG", "hero-7"), ("", "none", "pet-7"), (None, None, None)], "name string, path string, id string")
    got = [tuple(r) for r in rows.select(text.initial(F.col("name")), text.extension(F.col("path")), text.without_prefix(F.col("id"), "hero-")).collect()]
    assert got == [("山", "png", "7"), ("", "none", "pet-7"), ("", None, None)]

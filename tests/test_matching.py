"""Names, hashes and descriptors against brute force; ranks and running totals over ranges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluation, matching, ordering, vision


def test_names_in_one_walk(spark, monkeypatch):
    monkeypatch.setattr(matching, "NAMES_A_PASS", 2)
    names = [(1, "abc"), (2, "bc"), (3, "abc"), (4, ""), (5, None), (6, "山神"), (7, "c\nd"), (8, "zz")]
    texts = [(1, "xabcx\nbc"), (2, "ab\nc"), (3, ""), (4, None), (5, "山\n神山神"), (6, "c\nd"), (6, "bcz")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("name", F.lit("clash"))
    got = matching.names_in_lines(docs, spark.createDataFrame(names, "name_id long, name string")).collect()
    want = [(d, n) for d, t in texts for n, name in names if t and name and "\n" not in name and any(name in line for line in t.split("\n"))]
    assert sorted((r["doc_id"], r["name_id"]) for r in got) == sorted(want)
    assert matching.names_in_lines(docs.limit(0), spark.createDataFrame(names, "name_id long, name string")).collect() == []
    assert matching.names_in_lines(docs, spark.createDataFrame([], "name_id long, name string")).collect() == []


def hashes(rng, n):
    base = [rng.getrandbits(63) for _ in range(n // 4)]
    near = [b ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(9))) & (2**63 - 1) for b in base]
    return base + near + [rng.getrandbits(63) for _ in range(n - 2 * len(base))]


@pytest.mark.parametrize("radius,blocks", [(0, None), (5, None), (9, 4), (7, 8), (20, 4), (63, 0)])
def test_hashes_within_a_radius(spark, radius, blocks):
    rng = random.Random(radius)
    h = hashes(rng, 80)
    rows = spark.createDataFrame([(i, i % 2, x) for i, x in enumerate(h)] + [(99, 0, None)], "near long, k int, hash long")
    asked = spark.createDataFrame([(i, i % 2, x) for i, x in enumerate(h[:20])] + [(98, 1, None)], "q long, k int, q_hash long")
    got = sorted((r["q"], r["near"], r["distance"]) for r in matching.within_hamming(asked, rows, radius, ["k"], blocks=blocks).collect())
    assert got == sorted((i, j, (h[i] ^ h[j]).bit_count()) for i in range(20) for j in range(80) if i % 2 == j % 2 and (h[i] ^ h[j]).bit_count() <= radius)


def test_the_index_meets_few_pairs(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(hashes(rng, 2000))], "near long, hash long")
    asked = rows.limit(100).select(F.col("near").alias("q"), F.col("hash").alias("q_hash"))
    for floor, share in ((0.95, 0.01), (0.88, 0.05)):
        assert matching.candidates(asked, rows, vision.reach(floor)).count() < share * 100 * 2000
    assert matching.blocks_for(22, 50) == 0 and matching.blocks_for(0, 10**6) == 1  # all pairs only where that is less


def test_scores_above_a_floor_equal_brute_force(spark):
    rng = random.Random(8)
    row = lambda i, h: (i, i % 3, (h, [float(rng.randrange(256)) for _ in range(48)], 9.0))
    kind = f"id int, aspect_bucket int, signature {vision._SIGNATURE_TYPE}"
    h = hashes(rng, 60)
    c, r = spark.createDataFrame([row(i, x) for i, x in enumerate(h[:30])], kind), spark.createDataFrame([row(i, x) for i, x in enumerate(h[15:60])], kind)
    for floor in (0.6, 0.72, 0.9):
        pairs = c.alias("c").join(r.alias("r"), "aspect_bucket").withColumn("score", vision.similarity(F.col("c.signature"), F.col("r.signature"))).where(F.col("score") > floor)
        want = {(x[0], x[1]): x[2] for x in pairs.select("c.id", "r.id", "score").collect()}
        assert {(x["id"], x["ref_id"]): x["score"] for x in vision.compare(c, r, floor).collect()} == want
    assert vision.reach(1.0) == -1 and vision.reach(0.72) == 22


def test_growing_radius_finds_the_nearest(spark):
    rng = random.Random(2)
    h = hashes(rng, 120)
    h[7] = h[3]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(h)], "near long, hash long").withColumn("k", F.lit(1))
    asked = rows.where("near % 5 = 0").select(F.col("near").alias("q"), "k", F.col("hash").alias("q_hash"))
    got = sorted((r["q"], r["near"], r["distance"]) for r in matching.nearest_hashes(asked, rows, 3, "near", "q", ["k"]).collect())
    want = [(i, j, d) for i in range(0, 120, 5) for d, j in sorted(((h[i] ^ h[j]).bit_count(), j) for j in range(120) if j != i)[:3]]
    assert got == sorted(want)


def descriptors(rng, base, flips):
    return [[w ^ sum(1 << b for b in rng.sample(range(63), flips // 4)) for w in d] for d in base]


def test_two_nearest_descriptors_equal_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: [[rng.getrandbits(63) - (rng.random() < 0.5) * 2**63 for _ in range(4)] for _ in range(n)]
    base = make(60)
    q = [("g", i, d) for i, d in enumerate(descriptors(rng, base[:20], 4) + descriptors(rng, base[20:40], 40) + make(10) + [base[0]])] + [("h", 0, base[0]), ("n", 0, base[1])]
    t = [("g", i, d) for i, d in enumerate(base + [base[5]])] + [("h", 0, base[0])]
    kind = lambda x: f"group string, {x} int, {x}_words array<long>"
    queries, train = spark.createDataFrame(q, kind("q")), spark.createDataFrame(t, kind("t"))
    apart = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True))
    taken, want = set(), []
    for g, i, d in sorted(q):
        two = sorted((apart(d, e), j) for k, j, e in t if k == g)[:2]
        if len(two) == 2 and two[0][0] <= 70 and two[0][0] < 0.75 * two[1][0] and (g, two[0][1]) not in taken:
            taken.add((g, two[0][1]))
            want.append((g, i, two[0][1], two[0][0]))
    got = matching.nearest_descriptors(queries, train).collect()
    assert len(want) > 30 and sorted((r["group"], r["q"], r["t"], r["distance"]) for r in got) == sorted(want)
    met = matching.descriptor_pairs(queries.where("group = 'g'"), train, 0, 16).count()
    assert met < 0.1 * 51 * 61  # near ones meet, others hardly ever
    near = matching.descriptor_pairs(queries, train, 1, 16)
    assert near.count() == near.select("group", "q", "t").distinct().count()


def test_nearest_rows_in_tiles(spark, monkeypatch):
    for name, size in (("TILE_QUERIES", 3), ("TILE_ROWS", 5), ("TILE_PAIRS", 10)):
        monkeypatch.setattr(matching, name, size)
    rng = random.Random(4)
    h = hashes(rng, 40)
    rows = [(i % 30, i % 2, h[i % 40 if i % 3 else 0]) for i in range(90)] + [(50, 0, None), (None, 0, h[0]), (51, None, h[0])]  # repeated ids, hashes and rows
    held = spark.createDataFrame(rows, "near long, k int, hash long")
    asked = held.where("near % 5 = 0 OR near IS NULL").select(F.col("near").alias("q"), "k", F.col("hash").alias("q_hash"))
    found = matching.nearest_hashes(asked, held, 3, "near", "q", ["k"])
    sound = [r for r in rows if None not in r]
    want = []
    for q in {i for i, _, _ in sound if i % 5 == 0}:
        pairs = sorted(((x ^ y).bit_count(), j) for i, k, x in sound if i == q for j, m, y in sound if m == k and j != q)
        want += [(q, j, d) for d, j in pairs[:3]]
    assert sorted((r["q"], r["near"], r["distance"]) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "bit_count" not in plan  # a pair is no row of a plan
    assert matching.nearest_hashes(asked, held.limit(0), 3, "near", "q", ["k"]).collect() == []
    whole = matching.nearest_hashes(asked.drop("k"), held.drop("k"), 1, "near", "q")
    assert {r["q"] for r in whole.collect()} == {q for q, _, _ in want}
    words = lambda c, x: F.array(F.col(x), F.col(x).bitwiseXOR(F.lit(5))).alias(f"{c}_words")
    matches = matching.nearest_descriptors(asked.select(F.col("k").alias("group"), "q", words("q", "q_hash")), held.select(F.col("k").alias("group"), F.col("near").alias("t"), words("t", "hash")), ratio=2.0)
    plan = matches._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "bit_count" not in plan
    met = {}
    for q, k, x in sound:
        if q % 5 == 0:
            met.setdefault((k, q), []).extend((2 * (x ^ y).bit_count(), t) for t, m, y in sound if m == k)
    taken = {}
    for (k, q), pairs in sorted(met.items()):
        (d, t), (second, _) = sorted(pairs)[:2]
        if d <= 70 and d < 2.0 * second:
            taken.setdefault((k, t), (q, d))
    assert sorted((r["group"], r["t"], r["q"], r["distance"]) for r in matches.collect()) == sorted((*at, *v) for at, v in taken.items())


@pytest.mark.parametrize("limit", [10**9, 10])
def test_ranks_equal_sorted_lists(spark, monkeypatch, limit):
    monkeypatch.setattr(evaluation, "ONE_GRID_ROWS", limit)
    rng = random.Random(6)
    groups = {"wide": [rng.gauss(0, 100) for _ in range(5000)], "ties": [float(rng.choice([1, 1, 1, 2, 9])) for _ in range(3000)], "one": [4.0], "two": [1.0, 2.0], None: [3.0, 3.0, 8.0], "none": []}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("none", None), ("wide", None)]
    frame = spark.createDataFrame(rows, "g string, value double")
    shares = {"low": 0.001, "median": 0.5, "p95": 0.95, "most": 1.0}
    got = {r["g"]: r for r in evaluation.nearest_ranks(frame, ["g"], "value", shares).collect()}
    assert set(got) == {g for g, v in groups.items() if v}
    for g, r in got.items():
        values = sorted(groups[g])
        assert all(r[name] == values[max(1, math.ceil(s * len(values))) - 1] for name, s in shares.items()), g
    assert evaluation.nearest_ranks(frame.limit(0), ["g"], "value", shares).collect() == []


def test_running_totals_over_ranges(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(20), rng.choice([None, 1, 5, -2])) for i in range(4000)]
    frame = spark.createDataFrame(rows, "id long, k string, at int, v int")
    got = {r["id"]: r["total"] for r in ordering.running_total(frame, F.col("v"), [F.col("at"), F.col("id")], "k", ranges=7).collect()}
    sums, want = {}, {}
    for i, k, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = sums[k] = sums.get(k, 0) + (v or 0)
    assert got == want
    placed = ordering.numbered(frame, [F.col("at"), -F.col("id")]).orderBy("place").collect()
    assert [r["id"] for r in placed] == [r[0] for r in sorted(rows, key=lambda r: (r[2], -r[0]))] and [r["place"] for r in placed] == list(range(1, 4001))
    assert ordering.numbered(frame.limit(0), [F.col("id")]).collect() == []
    plan = ordering.numbered(frame, [F.col("id")])._jdf.queryExecution().toString()
    assert "windowspecdefinition(_key" not in plan  # no window over all rows


def test_boxes_judged_at_once_equal_single_ones():
    rng = np.random.default_rng(5)
    sums = vision.integral_images(rng.integers(0, 256, (90, 120, 4)).astype(np.uint8))
    boxes = np.array([(x, y, w, h) for x in (0, 7, 50) for y in (0, 3, 40) for w, h in ((16, 16), (33, 21), (60, 49))])
    flags, colours, deviation = vision.box_signatures(sums, boxes)
    for k, box in enumerate(boxes):
        bits, colour, spread = vision.signature(sums, *(int(v) for v in box))
        assert bits == vision._number(flags[k]) and colour == colours[k].tolist() and spread == deviation[k]


def test_window_sizes_of_known_images():
    assert vision.window_sizes(960, 540, 1.0) == [(w, w) for w in (48, 63, 83, 110, 145, 191, 252, 333, 440, 540)]
    assert vision.window_sizes(100, 100, 1.0) == [(48, 48), (63, 63), (83, 83), (100, 100)]
    assert vision.window_sizes(40, 40, 1.0) == [(40, 40)] and vision.window_sizes(15, 15, 1.0) == []

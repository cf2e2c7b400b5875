"""Jaccard classes, components and fingerprints against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import jaccard_join, simhash
from millrace.llm.components import components


def sets_of(texts, width):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def classes(ids, texts, width, up):
    sets, parent = sets_of(texts, width), list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i, j in combinations(range(len(ids)), 2):
        if ids[i] is not None and ids[j] is not None and sets[i] and sets[j]:
            if len(sets[i] & sets[j]) * 100 >= len(sets[i] | sets[j]) * up:
                parent[root(i)] = root(j)
                links += 1
    least = {}
    for i, key in enumerate(ids):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return {key: (len(sets[i]), least[root(i)]) for i, key in enumerate(ids) if key is not None}, links


def corpus(seed):
    """Chains, clusters, exact copies, a shared passage, and texts of every small size."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(50)]
    texts = []
    for _ in range(16):
        base = [rng.choice(words) for _ in range(rng.choice([2, 5, 12, 40, 100, 160]))]
        if rng.random() < 0.4:
            base += passage
        now = base
        for _ in range(rng.choice([1, 2, 8, 24])):
            t = list(now if rng.random() < 0.5 else base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(t))
            now = t
    texts += ["", None, " \t ", "one", "ONE", "two words", "Two words", "Éa b c", "éa b c"]
    ids = list(range(10, 10 + len(texts)))
    rng.shuffle(ids)
    return ids, texts


@pytest.mark.parametrize(("seed", "width", "up", "broadcast"), [(0, 3, 90, None), (1, 5, 80, 0)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, width, up, broadcast):
    """Also by shuffles alone."""
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", jaccard_join.BROADCAST_ROWS if broadcast is None else broadcast)
    monkeypatch.setattr(jaccard_join, "LED_ROWS", 5)
    ids, texts = corpus(seed)
    want, links = classes(ids, texts, width, up)
    rows = spark.createDataFrame([(i, t, i) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, id long")
    got = jaccard_join.classes_of(rows, width, up, 100).collect()
    assert links > 50 and len(got) == len(ids)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize(("seed", "width", "up"), [(0, 3, 90), (1, 5, 80)])
def test_all_links_equal_brute_force(spark, seed, width, up):
    ids, texts = corpus(seed)
    ids, texts = [*ids, None, 9], [*texts, texts[0], texts[0]]
    want, _ = classes(ids, texts, width, up)
    sets = sets_of(texts, width)
    n_links = dict.fromkeys((i for i in ids if i is not None), 0)
    for i, j in combinations(range(len(ids)), 2):
        if ids[i] is not None and ids[j] is not None and sets[i] and sets[j] and len(sets[i] & sets[j]) * 100 >= len(sets[i] | sets[j]) * up:
            n_links[ids[i]] += 1
            n_links[ids[j]] += 1
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = jaccard_join.linked_documents(rows, width, up, 100).collect()
    assert len(got) == len(ids) and max(n_links.values()) > 5
    assert {r["doc_id"]: (r["n_shingles"], r["n_links"], r["component_id"]) for r in got if r["doc_id"] is not None} == {k: (n, n_links[k], c) for k, (n, c) in want.items()}
    assert [(r["n_shingles"], r["n_links"], r["component_id"]) for r in got if r["doc_id"] is None] == [(len(sets[0]), 0, None)]


def near_misses(count, edits, seed=1):
    """Copies of one text with random words replaced."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(count):
        t = list(base)
        for e, at in enumerate(rng.sample(range(200), edits[k % len(edits)])):
            t[at] = f"e{k}_{e}"
        texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("edits", [[4], [0, 1, 2, 3, 4, 5, 6]])
def test_compared_pairs_grow_with_the_rows(spark, monkeypatch, edits):
    counted, stored = [], jaccard_join.common.stored
    monkeypatch.setattr(jaccard_join.common, "stored", lambda frame, label: (out := stored(frame, label), label in ("met", "named") and counted.append((label, out.count())))[0])
    most = {}
    for count in (60, 240):
        counted.clear()
        texts = near_misses(count, edits)
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.classes_of(rows).collect()}
        most[count] = sum(n for _, n in counted)
        assert got == {k: c for k, (_, c) in classes(list(range(count)), texts, 5, 80)[0].items()}
    assert most[240] <= 2 * 240 and most[240] <= 6 * max(most[60], 40)


def test_words_are_hashed_alike_in_blocks(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abAB é\n\t\x0b中") for _ in range(3000)) + " " + "x" * 500 + " tail"
    words = text.encode().lower().split()
    whole = jaccard_join._words(text.encode()).tolist()
    assert len(whole) == len(words) and len(set(whole)) == len(set(words))
    by_word = dict(zip(words, whole, strict=True))
    assert [by_word[w] for w in words] == whole
    for block in (1, 7, 64):
        monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", block)
        assert jaccard_join._words(text.encode()).tolist() == whole


def test_edges_and_empty_tables(spark):
    schema = "doc_id long, text string, component_id string"
    rows = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "x"), (5, "a b c d e f", None), (7, None, None)], schema)
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.classes_of(rows).collect()), key=str)
    assert got == [(1, 1), (1, 1), (5, 1), (7, 7), (None, None)]
    assert jaccard_join.classes_of(rows.limit(0)).collect() == []
    kept = jaccard_join.jaccard_stage(spark, rows, "")
    assert kept.columns == rows.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "7", "None"]


def test_threshold_is_met_exactly(spark):
    # 100 words make 98 shingles; changing the last k of them leaves (98 - k) / (98 + k)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base)] + [" ".join(base[: 100 - k] + [f"z{k}_{i}" for i in range(k)]) for k in (5, 6)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["component_id"] for r in jaccard_join.classes_of(rows, 3, 90, 100).orderBy("doc_id").collect()] == [0, 0, 2]


def test_classes_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(jaccard_join.ORACLE_SQL).fetchall()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_query(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame([(b, a) for a, b in edges] + [(None, 3), (5, None)], "a long, b long").where("a IS NOT NULL AND b IS NOT NULL")).collect()
    assert {r["id"]: r["component"] for r in got} == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_fingerprints_of_edits(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(50)) for _ in range(rng.choice([0, 1, 30, 200]))) for _ in range(40)]
    ids = rng.sample(range(1000), 40)
    texts[3] = texts[4]
    rows = spark.createDataFrame([(i, t or None, "c") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fingerprint string")
    got = {r["id"]: r for r in simhash.compare_with_edits(rows).collect()}
    order = sorted(zip(ids, texts, strict=True), reverse=True)
    assert len(got) == 40
    for k, (key, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[key]
        assert r["edited"] == edited and r["n_chars"] == len(t)
        marks = [simhash.fingerprint(x) for x in (t, edited, following)]
        assert r["fingerprint"] == marks[0].tobytes().hex() and r["edited_fingerprint"] == marks[1].tobytes().hex()
        assert r["near_edited"] == simhash.likeness(marks[0], marks[1]) and r["near_next"] == simhash.likeness(marks[0], marks[2])
    assert simhash.compare_with_edits(rows.limit(0)).collect() == []


def test_ranges_carry_over(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ROWS_A_RANGE", 3)
    rows = spark.createDataFrame([(i * i, f"text number {i}") for i in range(25)] + [(None, "last")], "doc_id long, text string")
    got = {r["id"]: r["edited"] for r in simhash.compare_with_edits(rows).collect()}
    order = [(i * i, f"text number {i}") for i in reversed(range(25))] + [(None, "last")]
    for k, (key, t) in enumerate(order):
        half = len(t) // 2
        assert got[key] == t[: len(t) - half] + order[(k + 1) % 26][1][:half]


def test_one_and_equal_documents(spark):
    rows = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert simhash.compare_with_edits(rows).first()["edited"] == "abab"
    long = "word " * 100_000
    a, b = simhash.fingerprints(spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string")).collect()
    assert a["fingerprint"] == b["fingerprint"]


def test_votes_equal_a_plain_count(monkeypatch):
    text = "the cat and the dog and the bird"
    mask = (1 << 64) - 1
    words = [xxhash.xxh3_64_intdigest(w.encode()) - (1 << 63) & mask for w in text.split()]
    count = {}
    for h in words:
        count[h] = count.get(h, 0) + 1
    for a, b in zip(words, words[1:]):
        two = (a * 0x9E3779B97F4A7C15 & mask) ^ b
        two = (two ^ (two >> 29)) * 0x9E3779B97F4A7C15 & mask
        count[two] = count.get(two, 0) + 1
    bits = []
    for lane in range(simhash.LANES):
        hashed = {}
        for h in count:
            x = h + ((lane + 1) * 0xD1B54A32D192ED03 & mask) & mask
            x = (x ^ (x >> 31)) * 0x94D049BB133111EB & mask
            x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & mask
            hashed[h] = x ^ (x >> 32)
        for byte in range(8):
            for bit in range(7, -1, -1):
                votes = sum((1 if hashed[h] >> (8 * byte + bit) & 1 else -1) * n**0.5 for h, n in count.items())
                bits.append(int(votes > 1e-6))
    want = np.packbits(np.array(bits, np.uint8))
    for block in (simhash.BLOCK_TERMS, 2, 5):
        monkeypatch.setattr(simhash, "BLOCK_TERMS", block)
        assert (simhash.fingerprint(text) == want).all()


def test_an_id_of_very_many_rows_is_dealt_to_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ROWS_A_RANGE", 10)
    rows = [(7, f"text {i}") for i in range(100)] + [(i, f"other {i}") for i in range(20)] + [(None, f"none {i}") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = simhash.with_next(frame)
    sizes = {r["_bucket"]: r["count"] for r in dealt.where("copy = 0").groupBy("_bucket").count().collect()}
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) <= 35
    got = simhash.compare_with_edits(frame).collect()
    hashed = {t: h for t, h in frame.select("text", F.xxhash64("text")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]), reverse=True)
    want = {t: t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2] for k, (_, t) in enumerate(order)}
    assert len(got) == len(rows) and {r["edited"] for r in got} == set(want.values())


def test_near_documents_equal_brute_force(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(15):
        base = [rng.choice(words) for _ in range(400)]
        texts.append(" ".join(base))
        for k in (1, 2, 5, 40):
            texts.append(" ".join(base[:-k] + [rng.choice(words) for _ in range(k)]))
    texts += [texts[0], texts[5], "", None, " "]
    ids = [4 * i for i in range(len(texts))]
    marks = {i: int(simhash.fingerprint(t).tobytes().hex(), 16) for i, t in zip(ids, texts, strict=True)}
    least = {}
    for i in ids:
        least.setdefault(marks[i], i)
    want = {(a, b, (marks[a] ^ m).bit_count()) for a in ids for m, b in least.items() if a % 20 == 0 and a != b and marks[a] and m and (marks[a] ^ m).bit_count() <= simhash.RADIUS}
    frame = spark.createDataFrame([*zip(ids, texts, strict=True), (None, texts[0])], "doc_id long, text string")
    assert {tuple(r) for r in simhash.near_documents(frame).collect()} == want and len(want) > 3
    with pytest.raises(ValueError, match="16 bits"):
        simhash.within_radius(frame, frame, 30)


@pytest.mark.parametrize(("radius", "blocks"), [(3, None), (2, 4), (0, 2)])
def test_radius_search_finds_all(spark, radius, blocks):
    rng = np.random.default_rng(6)
    marks = [rng.bytes(32) for _ in range(30)]
    for m in list(marks[:12]):
        flipped = bytearray(m)
        for _ in range(int(rng.integers(1, 6))):
            flipped[int(rng.integers(32))] ^= 1 << int(rng.integers(8))
        marks.append(bytes(flipped))
    rows = spark.createDataFrame([(m.hex(),) for m in marks + marks[:3]] + [(None,)], "fingerprint string")
    got = {(r["query"], r["found"]): r["distance"] for r in simhash.within_radius(rows, rows, radius, blocks).collect()}
    far = lambda a, b: (int(a.hex(), 16) ^ int(b.hex(), 16)).bit_count()
    assert got == {(a.hex(), b.hex()): far(a, b) for a in marks for b in marks if far(a, b) <= radius}


def test_edited_digest(spark, tmp_path):
    spark.createDataFrame([(1, "ab"), (2, "cdé")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["edited_sha256"] for r in simhash.fingerprint_query(spark, str(tmp_path)).collect()}
    assert got == {2: hashlib.sha256("cda".encode()).hexdigest(), 1: hashlib.sha256("ac".encode()).hexdigest()}


def test_words_that_powers_modulo_two_to_the_64_cannot_tell_apart(spark):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.classes_of(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    words = [a, b, a[:8], a[:8] + "\0", "\0", "\0\0", a[:16], a[8:16] + a[:8], "x"]
    assert len(set(jaccard_join._words(" ".join(words).encode()).tolist())) == len(words)


def test_ids_beyond_doubles_beside_nulls(spark):
    rows = [(9007199254740993, "one two three four"), (None, "five six"), (9007199254740995, None), (9007199254740994, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [r["id"] for r in simhash.compare_with_edits(docs).collect()]
    assert sorted(i for i in got if i is not None) == sorted(i for i, _ in rows if i is not None) and got.count(None) == 1


def test_different_texts_with_one_key_are_both_kept(spark, monkeypatch):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "pqr")
    docs = spark.createDataFrame([(1, a), (2, a), (3, b), (4, c + " z"), (5, c + " y")], "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "text_key", lambda text: F.length(text).cast("long"))
    got = jaccard_join.one_of_each_class(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4]


def test_near_unlinked_copies_meet_hardly_any(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(200), 16):
            words[k] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    met, stored = {}, jaccard_join.common.stored

    def counted(frame, label):
        kept = stored(frame, label)
        met[label] = kept.count()
        return kept

    monkeypatch.setattr(jaccard_join.common, "stored", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.linked_documents(docs).agg(F.sum("n_links")).first()[0]
    assert got == 0 and met["met"] < 0.1 * 120 * 119 / 2


def test_entries_that_nobody_can_meet_are_not_kept(spark):
    """Members 7 and 8 are shared by sets of far sizes and too late in both; member 9 may lead to a link."""
    own = iter(range(1000, 2000))
    fill = lambda known: [known.get(k) or next(own) for k in range(11)]
    rows = [(1, 100, 1, 1, fill({0: 9, 1: 7, 9: 8})), (2, 101, 2, 2, fill({0: 9, 9: 8})), (3, 200, 3, 3, fill({0: 7}))]
    table = spark.createDataFrame(rows, "doc_id long, n long, s1 long, s2 long, prefix array<long>")
    classes, lists = jaccard_join.entries(table, jaccard_join.Threshold(90, 100))
    assert classes.count() == 3
    assert {(r["member"], r["id"]) for r in lists.collect()} == {(9, 1), (9, 2)}


def test_parity_maps_tell_large_sets_apart():
    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (6000, 4000))
    near = np.sort(np.concatenate([a[:-50], b[:30]]))
    maps = {k: jaccard_join.parity_map(x).tobytes() for k, x in (("a", a), ("b", b), ("near", near), ("few", a[:100]))}
    assert [len(m) for m in maps.values()] == [1024, 512, 1024, 64]
    # a linked pair of these sizes differs in at most 526 members
    assert 526 < jaccard_join.apart(maps["a"], maps["b"])[0] <= 10000
    least, likely = jaccard_join.apart(maps["a"], maps["near"])
    assert least <= 80 and 60 <= likely <= 100
    assert jaccard_join.apart(maps["few"], maps["a"])[0] <= 5900 and jaccard_join.apart(maps["b"], maps["b"]) == (0, 0.0)

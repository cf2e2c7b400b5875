"""Runs, phrases and divergence rules: brute force, SQL, edges."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import divergence_rules, lyndon_runs, phrase_collocations, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_divergence_rules", "op12_lyndon_runs", "op13_phrase_collocations"])
def test_matches_sql(spark, name):
    got = queries.queries()[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = got.select(*want.columns).collect()
    assert rows and sorted(map(tuple, rows), key=str) == sorted(want.fetchall(), key=str)


def plain_runs(words, min_length, exponent):
    found = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            if n >= max(min_length, exponent * q) and not any(s <= i and i + n <= s + m and p < q for s, m, p in found):
                found.add((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_plain_ones():
    rng = random.Random(5)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 5)):
            some = lambda n, k=rng.randint(1, 4): [rng.randint(1, k) for _ in range(n)]
            block = some(rng.randint(1, 6))
            texts.append(some(rng.randint(0, 6)) + block * rng.randint(0, 6) + block[:2] + some(rng.randint(0, 20)))
        for least, exponent in ((6, 4), (2, 2), (1, 3)):
            got = lyndon_runs.find_runs([np.array(t, np.int64) for t in texts], least, exponent)
            for text, runs in zip(texts, got, strict=True):
                assert [tuple(map(int, r)) for r in runs] == plain_runs(text, least, exponent)


def test_runs_of_difficult_words():
    a, b = [1], [1, 2]
    for _ in range(12):
        a, b = b, b + a  # Fibonacci words have most runs
    for text in (b, [1] * 5000, [1, 2] * 2500, list(range(1, 3001)), list(range(3000, 0, -1)), [1] * 300 + [2] + [1] * 300):
        runs = lyndon_runs.find_runs([np.array(text, np.int64)], 2, 2)[0]
        assert len(runs) < len(text)
        assert len(text) > 700 or [tuple(map(int, r)) for r in runs] == plain_runs(text, 2, 2)


def test_runs_edges(spark):
    rows = [(1, None, "x"), (2, "", None), (3, " \n\t", "y"), (4, "a b " * 4 + "c", "z"), (4, "a b " * 4 + "c", "z"), (None, "é é " * 6, ""), (7, "w " * 60_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in lyndon_runs.with_runs(docs).collect()]
    assert got[:3] == [(1, [], ""), (2, [], ""), (3, [], "")]
    assert got[3] == got[4] == (4, [(0, 8, 2)], "a b c")
    assert got[5] == (None, [(0, 6, 1)], "é é") and got[6] == (7, [(0, 60_000, 1)], "w")
    assert lyndon_runs.with_runs(docs.limit(0)).collect() == []


def test_planted_periods(spark):
    import zlib

    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(300)] + [(None, "a b")], "doc_id long, text string")
    for row in docs.select("doc_id", "text", lyndon_runs.planted(F.col("doc_id"), F.col("text")).alias("new")).collect():
        words, h = row["text"].split(), zlib.crc32(str(row["doc_id"]).encode())
        want, n, g = list(words), len(words), h // 10
        if row["doc_id"] is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert row["new"].split() == want


def plain_phrases(rows, max_n):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for mark in ".,;:!?\n\v\f\r":
            text = text.replace(mark, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            sizes[lang or "und"] += len(words)
            counts.update((lang or "und", " ".join(words[i : i + n])) for n in range(1, max_n + 1) for i in range(len(words) - n + 1))
    return counts, sizes


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(phrase_collocations, "BLOCK_WORDS", 7)


def test_phrases_and_scores_equal_plain_ones(spark, small_chunks):
    rng = random.Random(3)
    rows = [(" ".join(rng.choice(["a", "B", "b c", "É x", "d.", "e\t", "f,g", "  h\n"]) for _ in range(rng.randint(0, 60))), rng.choice(["x", "y", None, "z\nz"])) for _ in range(120)] + [(None, "x"), ("", None)]
    docs = spark.createDataFrame([(t, g, 1) for t, g in rows], "text string, lang string, phrase int")
    counts, sizes = plain_phrases(rows, 4)
    got = phrase_collocations.phrase_counts(docs, 4).collect()
    assert {(r["lang"], r["phrase"]): r["f"] for r in got} == {**counts, **{(g, ""): n for g, n in sizes.items() if n}}

    want = []
    for (lang, phrase), a in counts.items():
        words = phrase.split(" ")
        longer = [f for (g, p), f in counts.items() if g == lang and f >= 10 and len(p.split(" ")) > len(words) and f" {phrase} " in f" {p} "]
        if len(words) > 1 and a >= 10 and not any(100 * f >= 50 * a for f in longer):
            cuts = [(counts[lang, " ".join(words[:k])], counts[lang, " ".join(words[k:])]) for k in range(1, len(words))]
            score, l, r = min((1_000_000 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))[0:1] + min((1_000_000 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))[2:]
            want.append((lang, phrase, a, l, r, sizes[lang], score))
    found = phrase_collocations.collocations(docs, 4).collect()
    assert len(want) > 20 and sorted((r["lang"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found) == sorted(want)
    for lang in sizes:
        mine = sorted((r for r in found if r["lang"] == lang), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert mine == sorted(mine, key=lambda r: (-r["score"], -r["a"], r["phrase"].encode()))


def test_scores_pass_64_bits(spark):
    a, l, r = 9 * 10**14, 10**15, 10**15 - 7
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(phrase_collocations._score().alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (l * r)


def test_phrases_of_empty_tables_and_of_one_long_text(spark):
    docs = spark.createDataFrame([("same words here " * 70_000, None)], "text string, lang string")
    assert phrase_collocations.collocations(docs.limit(0)).collect() == []
    assert phrase_collocations.collocations(docs.withColumn("text", F.lit(None).cast("string"))).collect() == []
    counts = {r["phrase"]: r["f"] for r in phrase_collocations.phrase_counts(docs).collect()}
    assert counts[""] == 210_000 and counts["same words here"] == 70_000 and counts["here same words"] == 69_999


def plain_measures(text):
    text = text or ""
    for blank in "\t\v\f\r":
        words = text.replace(blank, " ")
        text, words = text, words
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, seen, copies = text.split("\n"), set(), 0
    for line in lines:
        if any(c not in " \t\v\f\r" for c in line):
            copies += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), copies, len(covered)


def test_measures_equal_plain_ones(spark):
    rng = random.Random(9)
    texts = [None, "", " \n ", "a b c d", "x y z x y z", "# $\n# $\n \n \n| |"]
    texts += ["".join(rng.choice(["a ", "b ", "\n", "#", "É ", "c\t", "| ", "9 "]) for _ in range(rng.randint(0, 200))) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, words string")
    for row in divergence_rules.with_rules(docs).collect():
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_measures(texts[row["row"]["doc_id"]])
        assert row["base_failed"] == (row["n_words"] < 50 or 100 * row["n_repeat_words"] > 50 * row["n_words"])


def test_distance_is_the_jensen_shannon_distance(spark):
    rng = np.random.default_rng(4)
    for _ in range(5):
        p, q = rng.dirichlet(np.ones(7)), rng.dirichlet(np.ones(7))
        p[2] = 0
        p /= p.sum()
        m = (p + q) / 2
        bits = lambda x: np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0]))  # noqa: E731, B023
        row = spark.createDataFrame([(p.tolist(), q.tolist())], "p array<double>, q array<double>").select(divergence_rules.distance(F.col("p"), F.col("q")).alias("d")).first()
        assert row["d"] == pytest.approx(np.sqrt((bits(p) + bits(q)) / 2), abs=1e-8)
    same = spark.createDataFrame([([0.5, 0.5, 0.0], [0.0, 0.0, 1.0])], "p array<double>, q array<double>").select(divergence_rules.distance(F.col("p"), F.col("p")).alias("s"), divergence_rules.distance(F.col("p"), F.col("q")).alias("d")).first()
    assert tuple(same) == (0.0, 1.0)


def test_rules_reject_what_labels_call_bad(spark):
    sf = "/root/testdata/sf0.01"
    got = divergence_rules.rules_query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("n_words >= 50").collect()
    bad, good = [r["kept"] for r in got if r["quality"] == 0], [r["kept"] for r in got if r["quality"] == 1]
    assert len(bad) > 20 and not any(bad) and np.mean(good) > 0.99


def test_rules_without_languages_and_rows(spark):
    clean = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'fr'").limit(30)
    docs = clean.select("text", "lang").union(clean.limit(5).select("text", F.lit(None))).union(clean.limit(5).select("text", F.lit("rare")))
    by = {(r["row"]["text"], r["row"]["lang"]): r["kept"] for r in divergence_rules.with_rules(docs).collect()}
    assert all(by[t, g] == by[t, "fr"] for t, g in by if g in (None,))
    assert divergence_rules.with_rules(docs.limit(0)).collect() == []
    none = docs.limit(3).select(F.lit(None).cast("string").alias("text"), "lang")
    assert [r["kept"] for r in divergence_rules.with_rules(none).collect()] == [False] * 3

"""Quality and language: held-out accuracy, the vote against a plain one, edges."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality_knn, rank_langid

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    got = quality_knn.quality_query(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) > 30 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in rows]) >= 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.collect())


def test_vote_equals_a_plain_one():
    rng = np.random.default_rng(1)
    train = [" ".join(rng.choice(["alpha", "beta", "GAMMA!!", "| x", "d,"], 30)) for _ in range(60)]
    terms = np.array([quality_knn.term_weights(t) for t in train])
    labels = rng.integers(0, 2, 60).astype(float)
    voter = quality_knn.Voter(terms, labels)
    asked = terms[:10]
    vectors, queries = voter.latent(terms), voter.latent(asked)
    judged = 0
    for q, score in zip(queries, voter.score(asked), strict=True):
        cosines = [round(float(np.dot(q, v)), quality_knn.TIE_DIGITS) for v in vectors]
        edge = sorted(cosines)[-quality_knn.NEIGHBOURS]
        near = [i for i in range(60) if cosines[i] >= edge - 2e-5]
        if len({c for c in cosines if abs(c - edge) <= 2e-5}) == 1:  # rounding leaves no doubt
            weight = [max(cosines[i], 1e-6) ** quality_knn.SHARPNESS for i in near]
            assert score == pytest.approx(sum(w * labels[i] for w, i in zip(weight, near, strict=True)) / sum(weight), rel=1e-3)
            judged += 1
    assert judged >= 5


def test_equal_labelled_texts_all_vote():
    rng = np.random.default_rng(2)
    text = "one two three, four"
    terms = np.array([quality_knn.term_weights(text)] * 40 + [quality_knn.term_weights(" ".join(rng.choice(["a|", "B!", "cc"], 9))) for _ in range(20)])
    labels = np.array([1.0] * 10 + [0.0] * 30 + [1.0] * 20)
    scores = {float(quality_knn.Voter(terms[order], labels[order]).score(terms[:1])[0]) for order in (np.arange(60), np.arange(60)[::-1], rng.permutation(60))}
    assert all(s == pytest.approx(0.25, abs=1e-6) for s in scores)


def test_the_whole_word_makes_its_shape():
    assert quality_knn._shape("a" * 100 + "9") == "x9" and quality_knn._shape("a1" * 30) == "x9" * 30


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "good text " * 50_000, "x"), (4, "good text", "x"), (None, "good", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(4, 1), (4, 1), (3, None), (None, 1)], "doc_id long, quality int")
    voter = quality_knn.fit(docs, labels)
    got = quality_knn.scored(docs, voter).collect()
    assert [r["score"] for r in got[:3]] == [0, 0, 0] and got[3]["score"] == 1 and len(got) == 6
    none = quality_knn.fit(docs.limit(0), labels)
    assert [r["score"] for r in quality_knn.scored(docs, none).collect()][3] == 0.5
    assert quality_knn.scored(docs.limit(0), voter).collect() == []


def test_language_on_held_out_rows(spark):
    got = rank_langid.langid_query(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_grams_and_ranks_equal_plain_counting(monkeypatch):
    from collections import Counter

    text = "Übung, macht: den 3 Meister! " * 7 + "a"
    padded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in padded:
        padded = padded.replace("  ", " ")
    want = Counter()
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            if padded[i : i + n] != " ":
                want[padded[i : i + n]] += 1
    code = lambda g: sum(ord(c) << (21 * k) for k, c in enumerate(reversed(g)))
    for block in (10_000, 7, 50):
        monkeypatch.setattr(rank_langid, "BLOCK_CHARS", block)
        codes, counts = rank_langid.gram_counts(text)
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {code(g): n for g, n in want.items()}
    top = rank_langid.ranked(codes, counts, 20)
    assert top.tolist() == sorted(codes.tolist(), key=lambda c: (-dict(zip(codes.tolist(), counts.tolist()))[c], c))[:20]


def test_language_edges(spark):
    docs = spark.createDataFrame(
        [(i, t, g, "x") for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("", None), ("12 34 !", "de"), ("the dog " * 80_000, None)])],
        "doc_id long, text string, lang string, score string",
    )
    profiles = rank_langid.learn_profiles(docs)
    assert set(profiles) == {"en", "de"}
    got = [r["lang_pred"] for r in rank_langid.identify(docs, profiles).orderBy("doc_id").collect()]
    assert got == ["en", "de", "und", "und", "und", "en"]
    assert rank_langid.learn_profiles(docs.where("lang IS NULL")) == {}
    assert rank_langid.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    kept = rank_langid.language_stage(spark, docs, "")
    assert kept.columns == docs.columns


def plain_grams(text):
    from collections import Counter

    padded = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ")) + " "
    while "  " in padded:
        padded = padded.replace("  ", " ")
    return Counter(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")


def code(gram):
    return sum(ord(c) << (21 * k) for k, c in enumerate(reversed(gram)))


def test_profiles_and_predictions_equal_plain_ones(spark):
    """Every document weighs the same; a profile's order and a document's distances are those of plain lists."""
    rng = np.random.default_rng(8)
    words = {"a": ["ana", "bana", "cab", "da"], "b": ["xyx", "zyz", "yx", "da"], "c": ["mno", "nom", "omo", "ana"]}
    rows = [(i, " ".join(rng.choice(words[g], 1 + i % 9)), g) for i, g in enumerate("abc" * 20)] + [(99, None, "a"), (98, "1 2", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    size = 25
    got = rank_langid.learn_profiles(docs, size=size)
    want = {}
    for lang in words:
        weight = {}
        for _, text, g in rows:
            grams = plain_grams(text) if g == lang else {}
            for gram, n in grams.items():
                weight[gram] = weight.get(gram, 0.0) + n / sum(grams.values())
        rounded = {gram: round(w, 6) for gram, w in weight.items()}
        want[lang] = sorted(rounded, key=lambda gram: (-rounded[gram], code(gram)))[:size]
        weights = [rounded[next(g for g in rounded if code(g) == c)] for c in got[lang]]
        assert weights == sorted(weights, reverse=True) and weights[-1] >= rounded[want[lang][-1]] - 2e-6
        assert len(set(got[lang])) == len(want[lang])  # ties at the end may fall either way

    profiles = rank_langid.Profiles(got, size)
    for _, text, _ in rows:
        grams = plain_grams(text)
        top = sorted(grams, key=lambda gram: (-grams[gram], code(gram)))[:size]
        if not top:
            assert profiles.predict(text) == ("und", 0.0)
            continue
        apart = {g: sum(abs(i - got[g].index(code(gram))) if code(gram) in got[g] else size for i, gram in enumerate(top)) for g in sorted(got)}
        best = min(apart, key=lambda g: (apart[g], g))
        assert profiles.predict(text) == (best, pytest.approx(1 - apart[best] / (size * len(top))))

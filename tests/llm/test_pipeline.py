"""The pipeline's stages against what the operators' plain versions say."""

import corpus_pipeline
from pyspark.sql import functions as F

from millrace.llm import quality_knn, rank_langid
from test_duplicates import classes

SF = "/root/testdata/sf0.001"


def test_stages_and_their_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "ngram_jaccard_join", "best_fit_packing"]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept[-1], SF).cache()
        assert after.columns == docs.columns
        kept.append(after)
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3]

    rows = kept[0].collect()
    profiles = rank_langid.Profiles(rank_langid.learn_profiles(docs.where(~rank_langid.held_out(docs["doc_id"]))), rank_langid.PROFILE_SIZE)
    assert ids[1] == {r["doc_id"] for r in rows if profiles.predict(r["text"])[0] != "und"}

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [i for i in ids[1] if i in labels]
    assert sum((i in ids[2]) == (labels[i] == 1) for i in judged) >= 0.97 * len(judged)
    assert sum(labels[i] == 1 and i not in ids[2] for i in judged) == 0

    third = kept[2].select("doc_id", "text").collect()
    want, _ = classes([r["doc_id"] for r in third], [r["text"] for r in third], 5, 80)
    assert ids[3] == {c for _, c in want.values()}

    packed = corpus_pipeline.STAGES[-1][1](spark, kept[3], SF).collect()
    assert {r["doc_id"] for r in packed} == ids[3]
    ran = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, ran)) == sorted(map(tuple, packed))


def test_stages_take_empty_tables_and_extra_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("n_chars", "score")
    for data in (docs.limit(0), docs.limit(5)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, data, SF).collect()
    assert quality_knn.THRESHOLD == 0.3


def test_one_row_of_each_class_stays(spark):
    a, near, other = (" ".join(f"w{k}" for k in range(n, n + 60)) for n in (0, 1, 500))
    rows = [(1, a, "x"), (1, a, "y"), (None, a, "z"), (5, near, None), (5, other, None), (None, other, "x"), (None, "only here, without an id", "x"), (7, None, None), (None, " ", None), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class string")
    got = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[4], rows[6], *rows[7:]], key=str)


def test_stages_take_ids_that_are_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.withColumn("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == docs.columns and after.count()
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.count()

"""The corpus pipeline: language, quality, near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bestfit_packing, common, jaccard_join, quality_knn, rank_langid

STAGES = [
    ("language_id", rank_langid.language_stage),
    ("quality_classifier", quality_knn.quality_stage),
    ("ngram_jaccard_join", jaccard_join.one_of_each_class),
    ("best_fit_packing", bestfit_packing.packing_stage),
]

#: Learnt profiles and neighbours cannot be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again for the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

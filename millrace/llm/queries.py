"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bestfit_packing,
    chroma_media,
    divergence_rules,
    feistel_shards,
    jaccard_join,
    lineblock_html,
    lyndon_runs,
    monoid_bpe,
    phrase_collocations,
    preference_chat,
    quality_knn,
    rank_langid,
    simhash,
)

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``digest_query`` with the installed vocabulary; the only query that needs that package."""
    import public_tokenizers

    return monoid_bpe.digest_query(spark, sf_dir, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_knn": quality_knn.quality_query,
        "op2_preference_chat": preference_chat.preference_query,
        "op3_bestfit_packing": bestfit_packing.packing_query,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_jaccard_join": jaccard_join.jaccard_query,
        "op6_feistel_shards": feistel_shards.shards_query,
        "op7_rank_langid": rank_langid.langid_query,
        "op8_chroma_media": chroma_media.media_query,
        "op9_lineblock_html": lineblock_html.pages_query,
        "op10_simhash": simhash.fingerprint_query,
        "op11_divergence_rules": divergence_rules.rules_query,
        "op12_lyndon_runs": lyndon_runs.runs_query,
        "op13_phrase_collocations": phrase_collocations.collocations_query,
        "jaccard_links": jaccard_join.links_query,
        "simhash_within_radius": simhash.near_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_preference_chat": preference_chat.ORACLE_SQL,
        "op5_jaccard_join": jaccard_join.ORACLE_SQL,
        "jaccard_links": jaccard_join.LINKS_SQL,
        "op11_divergence_rules": divergence_rules.ORACLE_SQL,
        "op12_lyndon_runs": lyndon_runs.ORACLE_SQL,
        "op13_phrase_collocations": phrase_collocations.ORACLE_SQL,
    }

"""The corpus operators as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronolith.llm.frames import table
from chronolith.llm.oracles import ORACLE_SQL


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolith.llm.jaccard import similarity_groups

    return similarity_groups(table(spark, sf_dir, "documents"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolith.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolith.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolith.llm.media import media_features

    return media_features(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolith.llm.debruijn import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolith.llm.secrets import secret_spans

    return secret_spans(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from chronolith.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolith.llm.suffixes import remove_matches

    return remove_matches(table(spark, sf_dir, "documents"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolith.llm.pii import pseudonymize, session_key

    return pseudonymize(table(spark, sf_dir, "documents"), session_key(spark)).select("doc_id", "text", "n_entities", "spans")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolith.llm.contamination import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolith.llm.manifest import manifest

    return manifest(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolith.llm.audit import filter_interactions

    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolith.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES"]

_ALL = (
    op1_ngram_jaccard,
    op2_license_scans,
    op3_toxicity,
    op4_media_columns,
    op5_substring_dedup,
    op6_secret_scans,
    op7_packing,
    op8_suffix_dedup,
    op9_pii_surrogates,
    op10_decontamination,
    op11_merkle_manifest,
    op12_filter_audit,
    op13_minhash_dedup,
    pipeline,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

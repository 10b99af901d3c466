"""Registered queries of the operators over whole tables, with their contract columns, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewash.llm import (
    bitmask_langid, byte_cnn_quality, centroid_clusters, decontam_mih, filter_audit, forced_bpe, mih_ann,
    pii_boost, pst_lm, secret_forest, simhash_vptree, suffix_family, superminhash)
from cubewash.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    """The installed public tokenizer file; only its path is used here."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vptree.near_duplicates(table(spark, sf_dir, "documents"))


def op2_mih_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_family.removal_digests(table(spark, sf_dir, "documents"))


def op4_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst_lm.score(table(spark, sf_dir, "documents"))


def op5_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forced_bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bitmask_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmask_langid.predict_language(table(spark, sf_dir, "documents"))


def op8_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boost.personal_data_digests(table(spark, sf_dir, "documents"))


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.secret_digests(table(spark, sf_dir, "documents"))


def op10_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam_mih.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_simhash_vptree, op2_mih_ann, op3_suffix_family, op4_suffix_tree_lm, op5_forced_bpe,
    op6_byte_cnn_quality, op7_bitmask_langid, op8_pii_boost, op9_secret_forest,
    op10_simhash_decontamination, op11_filter_audit, op12_centroid_clusters, op13_superminhash)}

"""The corpus pipeline: quality, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. Filters drop rows, the
secret stage rewrites ``text``, and the last stage returns tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewash.llm import byte_cnn_quality, decontam_mih, forced_bpe, secret_forest, simhash_vptree
from cubewash.llm.common import Staging, table
from cubewash.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the byte-level network accepts; labels of the training folds are all it learns from."""
    return byte_cnn_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash_vptree.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window like a benchmark item."""
    return decontam_mih.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their text replaced."""
    return secret_forest.redact_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, decoded_sha256: ids of each text, and what they decode to."""
    shared = forced_bpe.share(spark, tokenizer_path())
    coded = docs.select("doc_id", forced_bpe.encode_decode_column(shared, F.col("text")).alias("c"))
    return coded.select("doc_id", F.size("c.token_ids").cast("long").alias("n_tokens"), "c.token_ids",
                        "c.decoded_sha256")


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secrets),
    ("bpe_encode_decode", tokens),
]

#: A trained network, SimHash components and a trained forest have no SQL form; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again in the shared folder."""
    staging = Staging(spark, "corpus_pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staging.write(stage(spark, docs, sf_dir))
    return docs

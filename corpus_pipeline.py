"""The corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, token ids. Each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import bpe, decontamination, disclosure, quality, simhash
from sieveline.llm.common import saved, table

#: SQL can express neither the classifier nor the tokenizer; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 6 accepts; it learns from the labels of sf_dir."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of operator 10: that with the smallest doc_id."""
    return simhash.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark of sf_dir, by operator 8."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_sanitiser(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced by operator 5."""
    return disclosure.sanitised(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text of every document, by operator 7."""
    return bpe.encode_documents(docs.select("doc_id", "text"), with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("pii", pii_sanitiser),
    ("bpe encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the digests of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs.select(F.col("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")

"""The registered queries of this package, with production parameters, and SQL where SQL can express a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import bpe, contracts, decontamination, disclosure, htmltext, licenses, outliers, packing, phrases, quality, sharding, simhash, tandem, tokenfiles
from sieveline.llm.common import table


def op1_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents"))


def op3_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_texts(table(spark, sf_dir, "pages"))


def op4_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_disclosure_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digests(disclosure.find(table(spark, sf_dir, "documents")))


def op6_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op8_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_file_digests(spark, table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op11_large_item_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op12_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.digests(tandem.find(table(spark, sf_dir, "documents"), planted=True))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_balanced_label_propagation,
        op2_robust_outliers,
        op3_text_density,
        op4_license_diagonals,
        op5_disclosure_sanitiser,
        op6_random_indexing_quality,
        op7_bpe_pair_index,
        op8_qgram_decontamination,
        op9_token_id_files,
        op10_simhash_near_dedup,
        op11_large_item_packing,
        op12_tandem_runs,
        op13_phrase_collocations,
    )
} | contracts.QUERIES
ORACLES: dict[str, str] = contracts.ORACLES | {"op13_phrase_collocations": phrases.ORACLE}

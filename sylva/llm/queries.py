"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sylva.llm import decontaminate, exact_dedup, filter_audit, language, near_dedup, packing, preference, quality, revisit, secret_scan, suffix_dedup, url_filter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(repr, url_filter.RULES)) + " AS rules(host, path, verdict)")
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.neighbours_as_pairs(_table(spark, sf_dir, "conversations")))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisit.digest(revisit.resolve(revisit.captures(_table(spark, sf_dir, "pages"))))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("items", "spans")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_duplicates(_table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents"))[0])


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find_groups(_table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(_table(spark, sf_dir, "embeddings"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_secret_scans": op9_secret_scans,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_language_id": op11_language_id,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_filter_interaction_audit": op13_filter_interaction_audit,
}

ORACLES = {
    "op1_url_filters": url_filter.ORACLE,
    "op4_chat_formatting": preference.ORACLE,
    "op5_warc_revisits": revisit.ORACLE,
    "op6_benchmark_decontamination": decontaminate.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op9_secret_scans": secret_scan.ORACLE,
    "op13_filter_interaction_audit": filter_audit.ORACLE,
}

"""The queries of this package, over the tables ``documents embeddings pages benchmark conversations``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinstrand.llm import chat, decontaminate, html, langid, licenses, maxent, neighbours, packing, pii, simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(_table(spark, sf_dir, "pages"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.replace_personal_data(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_replaced")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maxent.score_held_out(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))
    return found.withColumn("mask", chat.spans_text(F.col("mask")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
    "op8_lm_scores": op8_lm_scores,
    "op9_chat_perspectives": op9_chat_perspectives,
    "op10_license_scan": op10_license_scan,
}

#: The other operators are trained, hashed or keyed; their tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op9_chat_perspectives": chat.ORACLE}

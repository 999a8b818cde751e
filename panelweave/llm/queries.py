"""Registered queries of the training-data operators, over whole tables and whole texts, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    best_fit_packing,
    graph_search,
    hard_negatives,
    masked_lm,
    near_dedup,
    packed_output,
    quality_classifier,
    quality_rules,
    secret_scan,
    sentencepiece_scan,
    simhash_trees,
    url_filter,
    vector_codes,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.encoding_report(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged_urls(_table(spark, sf_dir, "pages"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def op5_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.scores(_table(spark, sf_dir, "documents"))


def op6_packed_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_output.digests(packed_output.packed_matrices(_table(spark, sf_dir, "documents")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.packed_documents(_table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op8_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest(_table(spark, sf_dir, "embeddings"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(_table(spark, sf_dir, "embeddings"))


def op13_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trees.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_url_filter,
        op3_near_dedup,
        op4_secret_scan,
        op5_masked_lm,
        op6_packed_output,
        op7_best_fit_packing,
        op8_graph_search,
        op9_quality_rules,
        op10_quality_classifier,
        op11_vector_codes,
        op12_hard_negatives,
        op13_simhash_trees,
    )
}

# The others use a tokenizer, a trained model, a compressor or a graph search, which SQL cannot state.
ORACLES = {
    "op2_url_filter": url_filter.VERDICTS_SQL,
    "op3_near_dedup": near_dedup.CLASSES_SQL,
    "op9_quality_rules": quality_rules.REPORT_SQL,
    "op11_vector_codes": vector_codes.CODES_SQL,
    "op12_hard_negatives": hard_negatives.NEGATIVES_SQL,
}

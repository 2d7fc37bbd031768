"""The queries of this subpackage over the `documents`, `benchmark` and `pages` tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gritstone.llm import centroids, decontamination, fill_in_middle, interpolated_lm, jaccard_join, language_id, packing, pii, repetition, secret_scan, source_mix, token_files, url_filter


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op1(spark, _table(spark, sf_dir, "documents"), _public("word_bpe_49k.json"))


def op2_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op2(spark, _table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op3(_table(spark, sf_dir, "documents"))


def op4_exact_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op4(spark, _table(spark, sf_dir, "documents"), _public("byte_bpe_50k.json"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op5(_table(spark, sf_dir, "pages"))


def op6_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.op6(spark, _table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op7(spark, _table(spark, sf_dir, "documents"))


def op8_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op8(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.op9(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.op10(_table(spark, sf_dir, "documents"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.op11(_table(spark, sf_dir, "documents"))


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.op12(_table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.op13(_table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_token_files,
    op2_language_filters,
    op3_personal_data,
    op4_exact_packing,
    op5_url_rules,
    op6_interpolated_lm,
    op7_jaccard_join,
    op8_randomness_secrets,
    op9_decontamination,
    op10_repetition_rules,
    op11_source_mix,
    op12_sort_means,
    op13_fill_in_middle,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_rules": url_filter.OP5_SQL,
        "op11_source_mix": source_mix.OP11_SQL,
        "op12_sort_means": centroids.op12_sql(),
        "op13_fill_in_middle": fill_in_middle.OP13_SQL,
    }

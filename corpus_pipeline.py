"""A corpus pipeline: documents in, packed token sequences out.

Each stage takes all its predecessor kept and applies one operator of `gritstone.llm`. All but the last return the
columns of `documents`; the last returns one row per piece with its token ids and its place.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gritstone.llm import decontamination, jaccard_join, packing, pii, repetition
from gritstone.llm.common import discard, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return repetition.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id."""
    return jaccard_join.distinct_documents(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return pii.masked(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian 32-bit), sequence_id, offset."""
    return packing.pack_documents(docs, TOKENIZER).withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("benchmark leaks", benchmark_leaks), ("personal data", personal_data), ("packing", packed_sequences)]

#: Suffix arrays, the field and the packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's table is removed once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

"""Cleaning of a text corpus: stages over ``documents``, each one operator of pricelab.llm.

Every stage works on all rows its predecessor kept; between stages the rows
are written as Parquet to the shared folder and read again.
"""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelab.llm import bpe, common, decontaminate, langid, phrases, simhash
from pricelab.llm.common import table
from pricelab.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the labelled languages, without a letter or without a text go.

    Learns from the documents' own labels; without any labelled text nothing is rejected.
    """
    if docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).isEmpty():
        return docs
    return langid.accepted(docs, langid.train(docs, F.lit(True)))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays: its smallest doc_id (a null one
    counts as the largest), of rows that share that id the smallest text hash."""
    keep = simhash.representatives(docs, shingle=3, max_bits=3).toDF("__did", "__th")
    same = (common.did() == keep["__did"]) & (simhash.text_hash() == keep["__th"])
    return simhash.one_row_each(docs.join(keep, same, "left_semi"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 20 words and more that also start earlier are cut from the texts.

    A text that loses words is the others joined by one space, and n_chars is
    its new length; every document stays, even if no word does.
    """
    return phrases.without_repeats(docs, span=20)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), threshold=0.8, shingle=5)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document left."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_round_trip", bpe_round_trip),
]

#: SQL has no XXH64, no language model and no byte-pair merges; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

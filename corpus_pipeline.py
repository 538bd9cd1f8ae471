"""From raw documents to packed sequences, stage by stage.

Each stage reads what the one before it kept, written as Parquet, and returns
the columns of documents; the last returns the pieces of packed sequences. A
stage begins by removing the intermediate tables of the one before it, whose
result has to be written by then.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.common import durable, noting, remove
from lodestrata.llm.exact_dedup import drop_exact_copies
from lodestrata.llm.near_copies import keep_one_of_near_copies
from lodestrata.llm.packing import pack_documents
from lodestrata.llm.quality_rules import keep_quality
from lodestrata.llm.suffix_dedup import without_repeated_bytes

#: Words that a worker's tokenizer remembers: fewer than alone, as executors hold what earlier stages left.
KEPT_WORDS = 120_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[str, list[str]] = {}  # application: tables that its last stage rests on


def stage(work: Stage) -> Stage:
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        remove(spark, *_left.pop(application, []))
        with noting() as _left[application]:
            return work(spark, docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_quality(docs)


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal documents stays."""
    return drop_exact_copies(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: 5-word similarity of 0.8 or more."""
    return keep_one_of_near_copies(docs)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has go."""
    return without_repeated_bytes(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4,096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), kept_words=KEPT_WORDS)


STAGES = [("quality rules", quality), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies), ("suffix-array dedup", repeated_passages), ("packing", packed)]

#: Expectation-maximisation, similarity, byte strings and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, f"pipeline-{i}")
    return docs

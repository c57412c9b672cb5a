"""The corpus pipeline: language ID, exact dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Its result is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``docs``; the last returns a row for
each packed piece. Nulls, repeated rows, empty texts and empty tables are treated as each operator's module states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wardenflow.llm.common import documents, settle
from wardenflow.llm.exact_dedup import drop_exact_copies
from wardenflow.llm.language_id import keep_identified
from wardenflow.llm.mixing import mixed_documents
from wardenflow.llm.packing import packed
from wardenflow.llm.simhash_dedup import drop_near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told, as they have no letter, go."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text the one with the smallest id stays."""
    return drop_exact_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near fingerprints the one with the smallest id stays."""
    return drop_near_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; copies are rows of their own."""
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; a row for each piece."""
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no language model, XXH64 or tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = settle(docs, name)
    return docs

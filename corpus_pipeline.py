"""The corpus pipeline: quality classifier, quality rules, near-duplicate join, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; the first four return the
columns of documents. Rejected documents go, one document of each near-duplicate group stays, repeated passages are
cut from the texts, and the last stage packs what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelframe.llm import ngram_join, packing, quality_classifier, quality_rules, suffix_dedup
from reelframe.llm.common import checkpointed, table
from reelframe.llm.registry import vocabulary


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cleaned(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("ngram_join", join_near_copies),
    ("suffix_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: Trained scores and merges of vocabularies have no SQL form; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs

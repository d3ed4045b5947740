"""A training-data pipeline: five stages, each written as Parquet and read again by the next.

Quality rules and toxicity drop documents, near-dedup keeps one document of each class, substring dedup cuts repeated
passages out of texts, and packing returns the pieces of what is left with their places in sequences.

Defined cases: a null text counts as empty, and both fail the quality rules; very long texts go through whole; of rows
that tie in a class the smallest id, then the least text, stays; repeated rows are one class; rows with a null doc_id
take part, and their pieces have a null doc_id; further columns, whatever their names, ride along to the last stage,
which returns pieces; empty tables, and tables without labels, give what the stages' own rules say of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shapelake.llm import near_dup, packing, quality, substring_dedup, toxicity
from shapelake.llm.common import Scratch, table
from shapelake.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_docs(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filter_docs(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_from(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", best_fit_packing),
]
#: SQL cannot grow trees, sample weighted shingles or pack bins; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

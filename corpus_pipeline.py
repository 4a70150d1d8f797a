"""Corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import decontaminate, near_dedup, packing, quality, substring_dedup
from helixframe.llm.store import dropped, written

#: The stage's word shingles are of five words; the two-word sets are the contract of op8 alone.
NEAR = near_dedup.NearDedup(shingle=5)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep and do not call toxic.

    A null text has no words and goes. Repeated rows and rows without an id are judged like
    others; an empty table stays empty, and without labels only the base rules decide. Texts of
    any length are judged whole; equal labels and clashing column names change nothing.
    """
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component on five-word shingles: that with the smallest id.

    Rows that repeat this id stay together; rows without an id, a text or words stay. Texts of
    any length are compared whole, and columns of any name are kept as they are.
    """
    return near_dedup.without_near_duplicates(docs, NEAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of twenty words that stand in an earlier document or earlier in the text.

    Documents left without a word go; null and wordless ones stay. Rows that repeat an id are
    no source for each other; rows without an id lose only their own repeats. Of equal passages
    the first stays; texts of any length are parsed whole, columns of any name are kept.
    """
    return substring_dedup.without_duplicate_spans(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark; null texts and an empty benchmark take nothing.

    Repeated rows and items are judged each, texts of any length whole; columns of any name are kept.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, as pieces of packed sequences; a null text is its end id alone, repeated rows are packed each.

    A text longer than a sequence is cut; documents of equal length are placed in order of their ids.
    """
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packed_sequences),
]

#: SQL can't express the trained classifier or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each reading what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs, f"stage{number}")
            if last is not None:
                dropped(last)
            last = docs
    return docs

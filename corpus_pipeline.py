"""A corpus pipeline of five stages over `documents`; each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vecscene.llm import bpe, decontaminate, near_dedup, quality, substring_dedup
from vecscene.llm.common import discard, materialize, owned, read
from vecscene.llm.queries import VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest doc_id."""
    return near_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document holds go; texts without any stay as they are."""
    return substring_dedup.dedup_documents(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids that each remaining text encodes to, and of the bytes they decode to."""
    return bpe.encode_digest(docs, VOCABULARY)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", encode),
]

#: Near duplicates, passages and merges have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with owned() as kept:  # what a stage has written for itself goes with it
            new = materialize(stage(spark, docs, sf_dir).select(*docs.columns))
            kept.append(new)
        discard(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: five stages over table documents, each written as Parquet and read back by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. An empty table passes through every stage. What a stage writes for itself is removed when its
result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import mixing, near_dup, packing, quality, suffix_dedup
from nearfield.llm.common import new_path, table, written
from nearfield.llm.queries import vocabulary
from nearfield.sources.tables import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their source's adaptive limits reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the least doc_id."""
    return near_dup.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """50-byte strings that a document of smaller doc_id holds are cut from the text; n_chars follows."""
    cut = suffix_dedup.dedup(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target of its source takes it."""
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence of at most 2048 tokens and its place there."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("source mix", source_mix),
    ("packing", packed_sequences),
]

#: Packing is a search, which SQL can't state; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over table documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = new_path(spark, "pipeline")  # goes with the caller's scratch, not with a stage's
    for name, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), path=f"{folder}/{name.replace(' ', '-')}")
    return docs

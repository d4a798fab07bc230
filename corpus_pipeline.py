"""Corpus pipeline: quality rules, SimHash near-dedup, benchmark
decontamination, mixing to target weights, sharding.

Each stage is ``(name, function(spark, docs, sf_dir) -> DataFrame)`` and works on
all rows that the one before it kept; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the shared folder before the
next one starts, so every stage reads a table and a lost executor never costs
more than the stage that is running.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from herdflow.llm import decontam, mixing, quality_rules, shard_tree, simhash
from herdflow.operators.joins import materialize
from herdflow.sources.tables import table

SHARDS = 16
SHINGLE = 3
RADIUS = 3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counted rules and the n-gram ratio."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs, shingle=SHINGLE, radius=RADIUS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sources mixed by their natural shares, in mixed sequence, and
    noted as such: the sharding stage numbers its slots by the order found here."""
    return mixing.in_sequence(mixing.mixed(docs, hot_factor=None))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it, in mixed sequence: the
    order the mixing stage left, or a mix worked out here for other documents."""
    if mixing.is_in_sequence(docs):
        return shard_tree.place_in_order(docs, SHARDS)
    return shard_tree.place_in_sequence(docs, SHARDS)


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

# Edit distances and SimHash components are beyond SQL: tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        if i:
            docs = materialize(docs, "stage")
        docs = stage(spark, docs, sf_dir)
    return docs

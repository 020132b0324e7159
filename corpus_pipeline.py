"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of documents; the last returns the committed shards' rows.

Defined results, for every stage: each row is judged by its own text, whatever its doc_id. Null or
empty texts fail the quality rules. Rows that repeat, null ids and several texts under one id are
documents like others: of a group of near-duplicates one row stays, the one with the smallest id,
null last. A null source is a source of its own. Extra columns go through unchanged, whatever their
names. An empty table gives an empty result. A missing benchmark is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import decontaminate, mixing, near_dedup, quality_rules, sharding
from tabloom.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_passing(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document goes for a whole window of one item; items shorter than a window need company."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), least_short=2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.materialise(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]

#: Near-dedup by similarity of shingle sets is not practical SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The opN_ queries: each applies one operator, with production parameters, to its whole table. The
others show what the same operators answer beside that: ablations of the quality rules, and places
where benchmark words stand close together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import classifier, decontaminate, licenses, mixing, near_dedup, quality_rules, sharding, substring_dedup, tokens, warc
from tabloom.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "digest")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents"), width=4, threshold=80)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents")).drop("spans")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(quality_rules.measure(table(spark, sf_dir, "documents")))
    return quality_rules.ablate(led, [quality_rules.BASE, quality_rules.STANDARD])


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.near_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op3_near_dedup": op3_near_dedup,
    "op4_licenses": op4_licenses,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_warc": op9_warc,
    "op10_quality_classifier": op10_quality_classifier,
    "quality_ablation": quality_ablation,
    "benchmark_proximity": benchmark_proximity,
}

"""Queries of the text problems over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import consensus, cutoff, leakage, lookalike, mixture, reading, transcripts
from tallgrass.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.truncated(read(spark, sf_dir, "doc_targets"))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.truncation_report(read(spark, sf_dir, "doc_targets"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalikes(read(spark, sf_dir, "doc_targets"), read(spark, sf_dir, "target_list"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.alike_classes(read(spark, sf_dir, "doc_targets"), read(spark, sf_dir, "target_list"))


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.speaker_turns(read(spark, sf_dir, "tiktok"), read(spark, sf_dir, "speaker_author"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_turns(spark, sf_dir).select("video_id", "turn_no", "speaker_index", "start_ms")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = consensus.consensus(read(spark, sf_dir, "coded_pairs"))
    return items.where("coders >= 3").select("platform", "post_id", "target", "stance")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(read(spark, sf_dir, "coded_pairs"))[0]


def p7_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(read(spark, sf_dir, "coded_pairs"))[1]


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(p8_spans(spark, sf_dir))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.shares(p9_mix(spark, sf_dir), read(spark, sf_dir, "mix_targets"))


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(read(spark, sf_dir, "documents"), read(spark, sf_dir, "reading_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_levels(spark, sf_dir).where(F.col("level") == 4).select("doc_id")


QUERIES = {
    name: query
    for name, query in globals().items()
    if name.startswith("p") and name[1].isdigit() and callable(query)
}

"""Queries of the training-data operators over whole tables, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm import alignment, ann, decontam, langid, licenses, mixing, packing, quality, ranked, secrets, sharding, simhash, tokencount
from framesift.llm.common import arrow_batches, held_out, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), ~held_out())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    voters = quality.fit(docs, labels.where(~held_out()))
    return quality.score(docs, voters).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return simhash.components(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampled(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(~held_out()))
    return langid.predict(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), ~held_out())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return alignment.scored(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return packing.packed(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_sharding, op2_secrets, op3_quality, op4_simhash, op5_mixing, op6_language, op7_token_counts, op8_neighbours, op9_licences, op10_decontamination,
    op11_alignment, op12_ranked_search, op13_packing)}
ORACLES: dict[str, str] = {"op5_mixing": mixing.sql(), "op12_ranked_search": ranked.sql()}

"""Corpus pipeline: language identification, near-duplicates, decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the rows of ``docs`` that stay, with
all their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm import decontam, langid, mixing, nearsets, sharding
from framesift.llm.common import arrow_batches, held_out, table
from framesift.session import scratch_path


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without any letter go, and only those where no language could be learned."""
    arrow_batches(spark)
    net = langid.fit(docs.where(~held_out()))
    if not net.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(langid.language(F.col("text"), net) != langid.UNDETERMINED)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by sets of five-word shingles that agree to 0.8 or more.

    SimHash components (op4's operator, on these shingles) are the first groups whose sets are compared.
    """
    arrow_batches(spark)
    return nearsets.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 0.8 of its five-word shingles."""
    arrow_batches(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def balanced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens meet the raked marginals of source, language and topic."""
    return mixing.mixture(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.sharded(docs)


STAGES = [
    ("language", identified),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("mixing", balanced),
    ("sharding", sharded),
]

#: The first stage is a trained network and the second compares sets of shingles; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

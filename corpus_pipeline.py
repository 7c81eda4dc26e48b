"""From raw documents to shards: five stages, each one operator of irloom.llm.

Each stage takes (spark, docs, sf_dir) and returns documents (the last one with global_row, shard and slot besides). ``run``
writes every stage's result to the shared folder and reads it back, so no stage is computed twice and lost executors cost one
stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irloom.llm import decontamination, language_id, mixing, sharding, simhash
from irloom.llm.common import materialise, table

SHARDS = 8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifiers decide; what has no letter (``und``) or is ambiguous goes.

    The classifiers learn from the documents' own labels. A document without label gets the language they find; a label stays.
    Without any label there is nothing to decide by, and all documents stay as they are."""
    model = language_id.train(docs)
    if model is None:
        return docs
    judged = language_id.predict(docs, model, docs.columns)
    kept = judged.where((F.col("lang_pred") != language_id.UND) & ~F.col("ambiguous"))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles, similarity 0.8 or more; the smallest id stays."""
    return simhash.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontamination.without_passages(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources to their target weights: each document as often as the mix takes it."""
    mixed = mixing.copies(docs)
    return mixed.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).where("mix_copies > 0").select(*docs.columns)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot, by a Feistel permutation of the row numbers."""
    return sharding.shard(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: SQL has no XXH64, no trained classifiers and no banded alignment: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to shards for training: five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alertfold.llm import decontaminate, jaccard, labelled, mixing, quality, sharding
from alertfold.plans.storage import scratch_path

SHARDS = 24
MIN_QUALITY = 0.5
ORACLE_SQL = None
"""The first stage is a trained network; the others are checked by the SQL of their operators and by tests."""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, accepts."""
    rows = labelled.training(_table(spark, sf_dir, "labels"), "quality", 3, 1)
    model = quality.fit(docs, rows)
    return quality.score(docs, model).filter(f"score >= {MIN_QUALITY}").select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity, directly or through others, the one with the smallest doc_id."""
    return jaccard.one_per_component(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.without_hits(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard, their place in it, and the shard they would have with one more."""
    return sharding.into_shards(docs, SHARDS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("mixture", mix_sources),
    ("shards", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the folder in spark.checkpoint.dir holds what is between them."""
    docs = _table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            folder = scratch_path(spark, f"stage-{name}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs

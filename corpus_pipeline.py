"""A training corpus in stages: each takes the documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patchlight.llm import decontamination, language, mixing, neardup, sharding
from patchlight.llm.common import materialise, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Null texts and texts without letters go; repeated rows stay or go together; other columns stay."""
    return language.accepted(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal and nearly equal ones: that of the least key. Null texts stay, equal empty ones are a group; other columns stay."""
    return neardup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold too much of the benchmark. Null and empty texts hold nothing; repeated rows stay or go together; other columns stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights has them; those without words go, and one a source is cut where its quota ends. Other columns stay."""
    return mixing.apply(docs)


def put_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot, null keys and repeated rows among them. Columns of the names that it adds are replaced."""
    return sharding.shard(docs)


STAGES = [
    ("language ID", keep_known_languages),
    ("near-dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", put_into_shards),
]

#: Trained models and sampled hashes decide in some stages: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, with shard and slot. An empty table stays empty at every stage, and texts are taken whole, however long."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

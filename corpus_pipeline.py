"""The corpus pipeline: five stages, each applying one operator to all that its predecessor kept.

Every stage's result is written as Parquet in the shared folder and read again
as the next one's documents. Labels and benchmark come from ``sf_dir``. Every
stage takes an empty table to an empty one, reads texts whole however long, and
hands on columns of any name as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import common, decontaminate, mixing, ngram_join, sharding, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (a score of 0.5 or more) go.

    A null or empty text is scored as a window without words; null ids don't
    matter; repeated rows score alike and go or stay together; without labels of
    both classes nothing goes.
    """
    return toxicity.remove_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays.

    It is the one with the smallest id, of equal ids one text, of equal rows any
    one. Rows without an id keep one of their own in each group. Null and empty
    texts are in no group and all stay.
    """
    return ngram_join.keep_one(docs, words=5, share=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of ten words (or a shorter item's all) with a benchmark item go.

    Items without an id count, items without words don't. Null and empty texts
    stay; repeated rows go or stay together.
    """
    return decontaminate.remove_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources meet their target weights.

    The null source is a source of its own; null and empty texts weigh nothing
    and are taken at their source's rate; rows with null or equal ids and
    repeated rows toss coins of their own, the same ones in each run.
    """
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard; rows equal in id and text share one.

    Null texts take no bytes; null ids hash like empty ones. Columns n_bytes,
    shard and shard_bytes are added, replacing those of these names.
    """
    return sharding.assign_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the recurrent network of the first stage; tests compare the stages with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last returns the columns of documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

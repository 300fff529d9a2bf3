"""A training corpus from raw documents: stages that are each written as Parquet and read back for the next.

A reader of the result gets the documents that survive quality, near-duplicate and benchmark filters, repeated as the mix
asks, with the shard that each belongs to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pricescope.llm import crf_quality, decontaminate, mixing, near_dedup, sharding
from pricescope.llm.common import read
from pricescope.session import remove, shared_dir

SHARDS = 24


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the line classifier scores below one half."""
    return crf_quality.keep_good(docs, read(spark, sf_dir, "labels"), threshold=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8): the smallest doc_id."""
    return near_dedup.keep_one(docs, shingle=5, percent=80)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten consecutive words of a benchmark item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"), size=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix_documents(docs, max_copies=3)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of the documents and their shard."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("source mixing", mix_sources),
    ("sharding", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents. A stage's table goes when the next one is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


#: The classifier is fitted, so SQL can't express the whole; the tests hold every stage against a plain version of it.
ORACLE_SQL = None

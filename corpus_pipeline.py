"""The corpus pipeline over ``documents``: what is toxic, copied or leaked goes, the rest is mixed and sharded.

Each stage takes (spark, docs, sf_dir). ``run`` writes what a stage returns as
Parquet in the shared checkpoint folder and reads it again for the next one;
what a stage has read is deleted once its own result is written.

All stages but the last return the columns of ``docs`` as they are, whatever
their names; ``docs`` needs doc_id, text and source. Null and empty texts are
never toxic, are near copies of one another, hold no test words, and give the
mix no words, so they end there. Repeated rows are near copies. An empty table
gives empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import mixing, phrase_index, sharding, simhash
from plumbline.llm import toxicity as toxic_text
from plumbline.plans.runtime import ensure_checkpoint_dir, remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, trained on ``labels``, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxic_text.clean(docs, toxic_text.train(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: that of the smallest doc_id."""
    return simhash.keep_representatives(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which passages of ``benchmark`` make up less than a twentieth."""
    return phrase_index.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by target weights, as documents: one row for each pass that takes words of a document."""
    return mixing.mixed_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix, texts and all, with their size, checksum, shard and slot in 40 byte-balanced shards."""
    return sharding.sharded(docs, n_shards=40)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaked),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]
ORACLE_SQL = None  # the learned model, the permuted draws and the differencing are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, read from the folder that it was written to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs

"""A corpus pipeline: raw documents to token ids, in five stages.

Each stage reads what the one before it wrote and calls one operator of ``cpgspark.llm``.
All but the last return the columns of ``documents``; the last adds the ids, and its text
is what the ids decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cpgspark.llm import bpe, mixing, quality, simhash, substrings
from cpgspark.plans.durable import store


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the given labels."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.one_of_each(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that another document keeps; emptied documents go."""
    return substrings.without_passages(docs, length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document once for every pass that takes it."""
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text decoded from them."""
    tables = bpe.share_tables(spark)
    return bpe.decode(bpe.encode(docs, tables), tables, keep_ids=True)


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_passages),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode_texts),
]

#: The classifier is learned, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

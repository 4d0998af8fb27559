"""A training corpus from raw documents: five stages, each reading what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``.  The stages depend on each other only
through the documents, so each can be written to Parquet and the next one
started from there, also after a failure.

Edge cases are those of the operators: null and empty texts pass the filters,
repeated rows are one document of their class, texts of any length are read
whole, an empty table gives empty results, extra columns are carried to the mix
and left out by the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlake.llm import decontam, mixing, ngram_join, sharding, toxicity
from barlake.llm.common import drop_stored, stored_path
from barlake.llm.queries import SHARDS, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the lexicon is learned from the labels of these documents."""
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (five-word shingles, similarity 0.8 or more): the smallest doc_id."""
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word window with a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.mix(docs, mixing.label_weights(table(spark, sf_dir, "labels")))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of the mix."""
    return sharding.shard_plan(docs, SHARDS)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", join_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the learned lexicon, nor connected components over near-duplicate links at this size.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and reread; a stage's input is dropped once its output is written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        last = path
        docs, path = stored_path(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            drop_stored(spark, last)
    return STAGES[-1][1](spark, docs, sf_dir)

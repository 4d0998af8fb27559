"""Registered streaming queries: each lands driver-table data in a fresh zone under the
shared scratch folder, runs the stream once (AvailableNow) and returns the sink.

Re-running a stream on the same checkpoint adds nothing; that is covered by
the idempotency tests rather than repeated here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans import frames
from ..session import scratch_path
from ..sources.files import read_zone, write_parquet_partitions, write_raw_csv
from ..spec import CONFORMED_SCHEMA
from ..sources.tables import read_table
from . import jobs


def q_stream_copy_promote(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "copy-promote")
    schema = read_table(spark, sf, "events").schema
    jobs.copy_promote(spark, sf, f"{base}/conformed", f"{base}/_ckpt", schema, glob="events*.parquet")
    return spark.read.parquet(f"{base}/conformed")


def q_stream_raw_to_conformed(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "raw-to-conformed")
    write_raw_csv(frames.bars(spark, sf), f"{base}/raw")
    jobs.raw_to_conformed(spark, f"{base}/raw", f"{base}/conformed", f"{base}/_ckpt",
                          frames.INGEST_TS, frames.BATCH_ID)
    return read_zone(spark, f"{base}/conformed", CONFORMED_SCHEMA)


def q_stream_snapshot_refresh(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "snapshot-refresh")
    conformed = frames.hashed_ingests(spark, sf)
    write_parquet_partitions(conformed, f"{base}/conformed", "append")
    schema = conformed.schema  # declared types, partition columns included
    jobs.snapshot_refresh(spark, f"{base}/conformed", f"{base}/curated", f"{base}/_ckpt", schema)
    return read_zone(spark, f"{base}/curated", schema).select(*conformed.columns)


QUERIES = {
    "stream_copy_promote": q_stream_copy_promote,
    "stream_raw_to_conformed": q_stream_raw_to_conformed,
    "stream_snapshot_refresh": q_stream_snapshot_refresh,
}

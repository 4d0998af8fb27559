"""Shared derived frames for the registered queries (adaptor bars with lineage, returns, ...)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import raw_key
from ..operators import correlation, promote, returns
from ..sources import adaptors

# Fixed run parameters of the registered queries (arguments, never the wall clock).
INGEST_TS = dt.datetime(2024, 1, 2, 3, 4, 5)
BATCH_ID = "manual__2024-01-02T03:04:05"
AS_OF = "2001-11-04"
BACKFILL_AS_OF = "1996-06-30"
RUN_TS = dt.datetime(2024, 1, 2, 3, 4, 5)
WINDOW_DAYS = 45
SERIES_TICKER = "Brand#13"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptors.bars_brand(spark, sf_dir)


def faulted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptors.faulted_bars(bars(spark, sf_dir))


def user_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptors.bars_user(spark, sf_dir)


def conformed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars_brand promoted to conformed rows: lineage (source key = raw key) + row hash."""
    b = bars(spark, sf_dir)
    key = raw_key("dataset_id", "exchange", "trade_date", "ticker")
    return promote.to_conformed(b, INGEST_TS, BATCH_ID, source_key=key)


def hashed_ingests(spark: SparkSession, sf_dir: str, ingests: DataFrame | None = None) -> DataFrame:
    """Ingest records with a row hash over (key, open = px, volume = q); other measures absent."""
    i = adaptors.ingests(spark, sf_dir) if ingests is None else ingests
    shaped = i.withColumn("open", F.col("px")).withColumn("volume", F.col("q"))
    h = promote.row_hash_col(shaped.select("dataset_id", "exchange", "ticker", "trade_date", "open", "volume"))
    return shaped.withColumn("row_hash", h).drop("open", "volume")


def user_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.daily_returns(user_bars(spark, sf_dir))


def user_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.return_matrix(user_returns(spark, sf_dir))


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptors.redelivered(adaptors.ingests(spark, sf_dir))

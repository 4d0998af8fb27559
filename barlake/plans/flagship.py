"""Flagship plan: the minimum end-to-end slice of the lake.

ingest records (many per business key) -> row hash (conformed) -> latest
ingest wins per business key (curated snapshot) -> per-ticker calendar coverage
with the winner of the newest date, so that every step is part of the answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import business_days_between
from ..operators import curate
from . import frames


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage per series, with the hash and the source of the newest date's winner and the latest winning ingest."""
    snapshot = curate.latest_wins(frames.hashed_ingests(spark, sf_dir))
    cov = snapshot.groupBy("exchange", "ticker").agg(
        F.count(F.lit(1)).alias("rows"), F.min("trade_date").alias("start"), F.max("trade_date").alias("end"),
        F.max_by("row_hash", "trade_date").alias("last_row_hash"), F.max_by("source_object_key", "trade_date").alias("last_source_object_key"),
        F.max("ingest_ts").alias("last_ingest_ts"))
    expected = business_days_between("start", "end")
    return cov.select("exchange", "ticker", "rows", "start", "end", expected.alias("expected_bdays"), (expected - F.col("rows")).alias("missing_bdays"),
                      "last_row_hash", "last_source_object_key", "last_ingest_ts")

"""Dated universe: snapshots by date, the universe as of a day, and membership intervals between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import path_exists
from ..sources.listing import list_partitions
from .control import universe_snapshot

SNAPSHOT_DATE = "constituents_snapshot_date"


def write_universe(universe: DataFrame, path: str, snapshot_date=None) -> None:
    """Write a universe under its snapshot date, replacing that date's snapshot only.

    Without ``snapshot_date`` the rows carry their dates themselves.
    """
    rows = universe if snapshot_date is None else universe_snapshot(universe, snapshot_date)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SNAPSHOT_DATE).parquet(path)


def read_universe(spark: SparkSession, path: str, as_of=None) -> DataFrame:
    """All snapshots, or the newest one of a date up to ``as_of`` (chosen from a listing, so only its folder is read)."""
    if not path_exists(spark, path):
        raise RuntimeError(f"no universe snapshots in {path}")
    rows = spark.read.option("basePath", path).parquet(path).withColumn(SNAPSHOT_DATE, F.col(SNAPSHOT_DATE).cast("date"))
    if as_of is None:
        return rows
    dates = list_partitions(spark, path, {SNAPSHOT_DATE: "date"}, glob="*.parquet").where(F.col(SNAPSHOT_DATE) <= F.lit(as_of).cast("date"))
    return rows.where(F.col(SNAPSHOT_DATE) == F.lit(dates.agg(F.max(SNAPSHOT_DATE)).first()[0]))


def membership_changes(snapshots: DataFrame) -> DataFrame:
    """ticker, number and date of each snapshot at which a ticker enters or leaves (``entered`` true or false).

    Snapshots are numbered by date; each ticker's row of a snapshot meets its row
    of the one before in one full join, and rows without a partner are changes.
    A ticker that is in the last snapshot has not left.
    """
    dates = snapshots.select(F.col(SNAPSHOT_DATE).alias("date")).distinct()
    # one row per snapshot
    numbered = dates.select("date", F.row_number().over(Window.orderBy("date")).alias("number"))
    members = snapshots.join(numbered, F.col(SNAPSHOT_DATE) == F.col("date")).select("ticker", "number").distinct()
    here = members.select("ticker", "number", F.lit(True).alias("_here"))
    before = members.select("ticker", (F.col("number") + 1).alias("number"), F.lit(True).alias("_before"))
    changes = here.join(before, ["ticker", "number"], "full").where(F.col("_here").isNull() | F.col("_before").isNull())
    return changes.join(numbered, "number").select("ticker", "number", "date", F.col("_here").isNotNull().alias("entered"))


def membership_intervals(snapshots: DataFrame) -> DataFrame:
    """ticker, entered, left: spells in consecutive snapshots; ``left`` is the first snapshot without the ticker, null if it is still in.

    The window holds a ticker's changes only, at most one per snapshot.
    """
    w = Window.partitionBy("ticker").orderBy("number")
    changes = membership_changes(snapshots).withColumn("left", F.lead("date").over(w))
    return changes.where("entered").select("ticker", F.col("date").alias("entered"), "left")

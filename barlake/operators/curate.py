"""Conformed -> curated: exact-duplicate drop, latest ingest wins, stale partition detection."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import coerce_timestamp
from ..spec import OHLCV_DAILY


def exact_dedupe(df: DataFrame, key: Sequence[str] = OHLCV_DAILY.business_key,
                 hash_col: str = "row_hash", order: Sequence[str] = ("ingest_ts", "source_object_key")) -> DataFrame:
    """Drop exact re-deliveries: one row per (key, row_hash), the earliest ingest kept.

    ``min_by`` over a struct is combined on the map side (a sort aggregate, as
    the buffer holds a struct), so a hot key never has to be gathered in one task.
    """
    group = list(key) + [hash_col]
    rest = [c for c in df.columns if c not in group]
    ordering = F.struct(F.col(order[0]).isNull(), *[F.col(c) for c in order])
    picked = df.groupBy(*group).agg(F.min_by(F.struct(*rest), ordering).alias("_w"))
    return picked.select(*group, *[F.col("_w." + c).alias(c) for c in rest]).select(*df.columns)


def latest_wins(df: DataFrame, key: Sequence[str] = OHLCV_DAILY.business_key,
                order: Sequence[str] = ("ingest_ts", "source_object_key", "row_hash")) -> DataFrame:
    """One row per business key: the latest valid ``ingest_ts`` wins.

    A null (unparsable) timestamp ranks below every valid one; ties are
    broken by ``source_object_key`` then ``row_hash`` (largest wins).
    Expressed as ``max_by`` with a struct ordering: combined on the map side,
    no window over the key.
    """
    order = [c for c in order if c in df.columns]
    if "ingest_ts" in df.columns and df.schema["ingest_ts"].dataType.typeName() == "string":
        df = df.withColumn("ingest_ts", coerce_timestamp("ingest_ts"))  # text lineage: bad -> null
    rest = [c for c in df.columns if c not in key]
    ordering = F.struct(F.col(order[0]).isNotNull(), *[F.col(c) for c in order])
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), ordering).alias("_w"))
    return picked.select(*key, *[F.col("_w." + c).alias(c) for c in rest]).select(*df.columns)


def partition_freshness(listing: DataFrame, keys: Sequence[str] = ("trade_date",),
                        time_col: str = "modificationTime") -> DataFrame:
    """Newest modification time per partition of an object listing."""
    return listing.groupBy(*keys).agg(F.max(time_col).alias("last_modified"))


def newest_object(listing: DataFrame, time_col: str = "modificationTime", key_col: str = "path") -> DataFrame:
    """The most recently modified object (ties: largest key); empty listing gives no row."""
    return listing.orderBy(F.desc(time_col), F.desc(key_col)).limit(1)


def stale_partitions(conformed: DataFrame, curated: DataFrame, keys: Sequence[str] = ("trade_date",)) -> DataFrame:
    """Partitions whose newest conformed object is newer than the curated snapshot (or no snapshot).

    Both inputs are ``(keys..., last_modified)``; output ``keys..., conformed_modified,
    snapshot_modified``.  Partitions without conformed data are never stale.
    """
    c = conformed.select(*keys, F.col("last_modified").alias("conformed_modified"))
    s = curated.select(*keys, F.col("last_modified").alias("snapshot_modified"))
    return (c.join(s, list(keys), "left")
            .where(F.col("snapshot_modified").isNull() |
                   (F.col("snapshot_modified") < F.col("conformed_modified"))))


def build_snapshots(conformed: DataFrame, curated_path: str,
                    key: Sequence[str] = OHLCV_DAILY.business_key,
                    partition_cols: Sequence[str] = OHLCV_DAILY.partition_columns,
                    drop_exact_duplicates: bool = False) -> None:
    """Batch curation: latest ingest wins per key, written per trade date.

    With dynamic partition overwrite only the partitions present in the output
    are replaced, so untouched snapshots stay as they are; prune ``conformed``
    to the partitions to rebuild.
    """
    rows = conformed
    if drop_exact_duplicates:
        rows = exact_dedupe(rows, key)
    snap = latest_wins(rows, key)
    (snap.hint("rebalance", *partition_cols).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).parquet(curated_path))

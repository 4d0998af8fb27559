"""Raw -> conformed promotion: lineage columns, row hash, incremental (anti-join) selection."""

from __future__ import annotations

import datetime as dt
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import exact_double_text, iso_date
from ..functions.keys import conformed_key, trade_date_from_key
from ..sources.files import path_exists
from ..spec import OHLCV_DAILY, PRICE_COLUMNS, ROW_HASH_FIELDS, DatasetSpec
from ..streaming.commits import read_batches, write_batch


def _hash_text(df: DataFrame, name: str) -> Column:
    """Text of one hashed field: '' when the column is absent, 'nan' when null."""
    if name not in df.columns:
        return F.lit("")
    dtype = df.schema[name].dataType
    c = F.col(name)
    if name in PRICE_COLUMNS or isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = exact_double_text(c.cast("double"))
    elif isinstance(dtype, T.DateType):
        text = iso_date(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("nan"))


def row_hash_col(df: DataFrame, fields=ROW_HASH_FIELDS) -> Column:
    """SHA-256 (hex) of the business key, measures and currency joined by ``|``."""
    return F.sha2(F.concat_ws("|", *[_hash_text(df, f) for f in fields]), 256)


def add_row_hash(df: DataFrame, fields=ROW_HASH_FIELDS) -> DataFrame:
    return df.withColumn("row_hash", row_hash_col(df, fields))


def add_lineage(df: DataFrame, ingest_ts: dt.datetime | str, batch_id: str | None = None,
                source_key: Column | str | None = None, base_path: str | None = None) -> DataFrame:
    """Append ``ingest_ts``, ``ingest_batch_id`` and ``source_object_key``.

    ``ingest_ts`` and ``batch_id`` are arguments (never the wall clock inside
    the plan); the batch id defaults to the ISO text of ``ingest_ts``.  The
    source key defaults to the scanned file's path relative to ``base_path``.
    """
    ts = F.lit(ingest_ts).cast("timestamp")
    batch = F.lit(batch_id) if batch_id is not None else F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    if source_key is None:
        path = F.col("_metadata.file_path")
        if base_path:
            prefix = base_path.rstrip("/") + "/"
            path = F.regexp_replace(path, "^(file:)?" + _re_escape(prefix.replace("file:", "")), "")
        source_key = path
    elif isinstance(source_key, str):
        source_key = F.col(source_key)
    keep = [c for c in df.columns if c != "source_object_key"]  # an existing key is replaced
    return df.select(*keep, ts.alias("ingest_ts"), batch.alias("ingest_batch_id"),
                     source_key.alias("source_object_key"))


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def new_objects(candidates: DataFrame, existing: DataFrame, key: str = "key",
                mapper=conformed_key) -> DataFrame:
    """Candidate objects whose mapped key is not yet present (left anti join).

    The anti join is a shuffle on the key; Catalyst broadcasts ``existing``
    itself when its statistics say it is small.
    """
    mapped = candidates.withColumn("target_key", mapper(F.col(key)))
    have = existing.select(F.col(key).alias("target_key"))
    return mapped.join(have, "target_key", "left_anti")


def to_conformed(raw_rows: DataFrame, ingest_ts, batch_id: str | None = None,
                 source_key: str | Column | None = None, base_path: str | None = None, spec: DatasetSpec = OHLCV_DAILY) -> DataFrame:
    """Raw rows -> conformed rows (row + lineage + row_hash over the dataset's hash fields)."""
    return add_row_hash(add_lineage(raw_rows, ingest_ts, batch_id, source_key, base_path), spec.hash_fields)


def promote(raw_rows: DataFrame, conformed_existing: DataFrame | None, mode: str = "by_key",
            key: Sequence[str] = ("source_object_key",)) -> DataFrame:
    """Rows of ``raw_rows`` (already conformed-shaped) that the conformed zone lacks.

    ``by_key``     an object already promoted is never promoted again (append-only,
                   first conversion wins);
    ``by_content`` an object whose row hash differs from that of its newest stored
                   version is promoted again, so restatements reach the curated
                   latest-wins step, also one back to an earlier value.

    The newest version is chosen by the order of latest-wins, combined on the
    map side; the zone is to be pruned to the touched partitions by the caller.
    ``key`` may name columns that go with the object key, if rows are already
    spread and sorted by them.
    """
    key = list(key)
    if conformed_existing is None:
        return raw_rows
    if mode == "by_key":
        return raw_rows.join(conformed_existing.select(*key), key, "left_anti").select(*raw_rows.columns)
    if mode != "by_content":
        raise ValueError(f"unknown promotion mode {mode!r}")
    # a null time sorts first; a zone without ingest times has one version of an object
    order = F.struct(*[c for c in ("ingest_ts", "row_hash") if c in conformed_existing.columns])
    newest = conformed_existing.groupBy(*key).agg(F.max_by("row_hash", order).alias("_stored_hash"))
    changed = ~F.col("row_hash").eqNullSafe(F.col("_stored_hash"))
    return raw_rows.join(newest, key, "left").where(changed).select(*raw_rows.columns)


def object_part(key) -> Column:
    """Partition of an object sink: the date in the key, else its folder."""
    key = F.col(key) if isinstance(key, str) else key
    date = F.coalesce(trade_date_from_key(key), F.regexp_extract(key, r"_(\d{8})_\d{6}[^/]*$", 1))
    return F.when(date != "", date).otherwise(F.regexp_replace(key, "/?[^/]*$", ""))


def copy_new_objects(objects: DataFrame, sink: str, key: str = "key", stream: str = "copy", batch: int = 0) -> DataFrame:
    """Copy the objects (key, ..., content) whose key ``sink`` lacks, under their own keys; returns those copied.

    The rows go to the folder of this (stream, batch), so that a repeated batch
    replaces its own copies and adds none.  Of equal keys the newest
    (``modified``) is taken.  Only the key column of the parts (``object_part``)
    that the batch touches is read; contents are moved once.
    """
    spark = objects.sparkSession
    rest = [c for c in objects.columns if c != key]
    order = F.struct(*[c for c in ("modified",) if c in rest], *[c for c in rest if c != "modified"])
    newest = objects.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_v"))
    new = newest.select(key, *[F.col(f"_v.{c}").alias(c) for c in rest], object_part(key).alias("part"))
    if path_exists(spark, sink):
        # one part per date or folder of the batch
        parts = [r["part"] for r in objects.select(object_part(key).alias("part")).distinct().collect()]
        have = read_batches(spark, sink, T.StructType([objects.schema[key], T.StructField("part", T.StringType())]))
        own = F.col("stream").eqNullSafe(F.lit(stream)) & F.col("batch").eqNullSafe(F.lit(batch))
        new = new.join(have.where(F.col("part").isin(parts) & ~own).select(key), key, "left_anti")
    written = write_batch(new, sink, stream, batch, partition_cols=("part",))
    return spark.read.schema(objects.schema).parquet(written)

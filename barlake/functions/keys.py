"""Object-key expressions of the lake layout (hive-style path segments)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import HEARTBEAT_KEY_FORMAT, DatasetSpec
from .columns import col_, iso_date, local_time


def raw_key(dataset_id, exchange, trade_date, ticker) -> Column:
    """``tabular/<dataset>/exchange=<X>/trade_date=<YYYY-MM-DD>/ticker=<T>.csv``"""
    return F.concat(F.lit("tabular/"), col_(dataset_id), F.lit("/exchange="), col_(exchange),
                    F.lit("/trade_date="), iso_date(trade_date), F.lit("/ticker="), col_(ticker),
                    F.lit(".csv"))


def object_key(spec: DatasetSpec) -> Column:
    """Key of a row's raw object: ``tabular/<dataset>/<partition columns>/<object columns>.csv``, each ``name=value``."""
    parts = [F.lit("tabular/"), F.col("dataset_id")]
    for c in (*spec.partition_columns, *spec.object_columns):
        value = iso_date(c) if spec.raw_schema[c].dataType.typeName() == "date" else F.col(c).cast("string")
        parts += [F.lit(f"/{c}="), value]
    return F.concat(*parts, F.lit(".csv"))


def partition_prefix(dataset_id, exchange, trade_date=None) -> Column:
    parts = [F.lit("tabular/"), col_(dataset_id), F.lit("/exchange="), col_(exchange), F.lit("/")]
    if trade_date is not None:
        parts += [F.lit("trade_date="), iso_date(trade_date), F.lit("/")]
    return F.concat(*parts)


def curated_snapshot_key(dataset_id, exchange, trade_date) -> Column:
    return F.concat(partition_prefix(dataset_id, exchange, trade_date), F.lit("snapshot.parquet"))


def conformed_key(key) -> Column:
    """``.csv`` suffix becomes ``.parquet``; any other key gets ``.parquet`` appended."""
    key = col_(key)
    return F.when(key.endswith(".csv"), F.concat(F.left(key, F.length(key) - 4), F.lit(".parquet"))) \
            .otherwise(F.concat(key, F.lit(".parquet")))


def trade_date_from_key(key) -> Column:
    """Text after ``trade_date=`` up to the next ``/``; null unless it looks like ``....-..-..``."""
    key = col_(key)
    part = F.regexp_extract(key, "trade_date=([^/]*)", 1)
    return F.when(key.contains("trade_date=") & part.rlike("^.{4}-.{2}-.{2}$"), part)


def heartbeat_key(ts) -> Column:
    """Object key of a heartbeat written at UTC instant ``ts`` (local wall-clock stamp)."""
    head, tail = HEARTBEAT_KEY_FORMAT.split("{stamp}")
    return F.concat(F.lit(head), F.date_format(local_time(ts), "yyyyMMdd_HHmmss"), F.lit(tail))

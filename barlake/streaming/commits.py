"""Exactly-once sinks for micro-batches: every batch owns a folder, named by its query and its number.

A query that failed between its writes and its own commit runs the batch again
with the same number; writing then replaces the folder of that batch, whatever
the attempt before left there, and no other.  The id comes from the
checkpoint: it stays through restarts, and a new checkpoint gets a new one, so a
lost checkpoint never replaces what an earlier query wrote.
"""

from __future__ import annotations

import json
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.files import path_exists

#: Folder levels of a batch, in this order.
BATCH_COLUMNS = ("stream", "batch")


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the streaming query that a checkpoint belongs to."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()["value"])["id"]


def batch_path(sink: str, stream: str, batch: int) -> str:
    return f"{sink.rstrip('/')}/stream={stream}/batch={batch}"


def write_batch(rows: DataFrame, sink: str, stream: str, batch: int, fmt: str = "parquet", partition_cols: Sequence[str] = ()) -> str:
    """Write a batch's rows as its folder, replacing an earlier attempt's; returns the folder."""
    path = batch_path(sink, stream, batch)
    writer = rows.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partition_cols) if partition_cols else writer).save(path)
    return path


def read_batches(spark: SparkSession, sink: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """All batches' rows with ``stream`` and ``batch``; no rows if nothing was written."""
    full = T.StructType([*schema.fields, T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())])
    if not path_exists(spark, sink):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).format(fmt).option("basePath", sink).load(sink)

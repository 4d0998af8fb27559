"""Incremental zone promotion as Structured Streaming queries.

Each job is a file-source stream with its own checkpoint: the source log
remembers which objects were already processed, so a re-run picks up only
new objects (the "list both zones, skip known keys" loop of a scheduler
becomes the stream's offset log).  ``Trigger.AvailableNow`` processes what
is there and stops, which is what a 1/5/10-minute schedule needs; the same
code runs continuously with a processing-time trigger.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import curate, promote
from ..session import stored
from ..sources.files import (CORRUPT, FAULTS, OBJECT_HASH, current_raw_objects, object_columns, parsed, path_exists, read_zone,
                             relative_key, text_schema, touched_partitions, with_landing, with_object_hash, write_parquet_partitions)
from ..spec import OHLCV_DAILY, DatasetSpec
from .commits import stream_id, write_batch


def _run(writer, checkpoint: str, available_now: bool = True, timeout_s: int | None = None,
         trigger_seconds: int = 60):
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime=f"{trigger_seconds} seconds")
    q = writer.start()
    if available_now:
        q.awaitTermination(timeout_s)
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return q


def copy_promote(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: T.StructType,
                 fmt: str = "parquet", glob: str | None = None, available_now: bool = True):
    """Append the rows of every not-yet-seen file of ``source`` to ``sink`` unchanged (idempotent by the sink's log).

    For objects that must keep their key, see ``copy_objects``.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = reader.load(source)
    return _run(stream.writeStream.format(fmt).outputMode("append").option("path", sink),
                checkpoint, available_now)


def promote_batch(raw: DataFrame, conformed: str, ingest_ts: dt.datetime, batch_id: str | None, mode: str,
                  spec: DatasetSpec = OHLCV_DAILY) -> DataFrame:
    """Raw rows of one delivery -> the conformed rows that the zone lacked, appended to it.

    ``raw`` has each row's landing (``with_landing``).  Rows become logical
    objects (the most recently landed version of each key); the zone is read
    only in the touched partitions, and only key and version columns of it.  The
    join makes a repeated delivery add nothing; it works on the exchange and the
    order of the aggregate before it.
    """
    spark = raw.sparkSession
    rows = promote.add_lineage(current_raw_objects(raw, spec), ingest_ts, batch_id, source_key="source_object_key")
    existing = None
    if path_exists(spark, conformed):
        pairs = touched_partitions(raw, spec.partition_columns)
        existing = with_object_hash(read_zone(spark, conformed, spec.conformed_schema, pairs, spec.partition_columns), spec)
    if mode == "by_key":                                             # known objects need no row hash
        new = promote.add_row_hash(promote.promote(rows, existing, mode, object_columns(spec)), spec.hash_fields)
    else:
        new = promote.promote(promote.add_row_hash(rows, spec.hash_fields), existing, mode, object_columns(spec))
    new = new.drop(OBJECT_HASH)
    new = stored(new, "promoted")                                    # decided against the zone before appending to it
    write_parquet_partitions(new, conformed, "append", spec.partition_columns)
    return new


def raw_to_conformed(spark: SparkSession, raw: str, conformed: str, checkpoint: str,
                     ingest_ts: dt.datetime | None = None, batch_id: str | None = None, mode: str = "by_key",
                     spec: DatasetSpec = OHLCV_DAILY,
                     quarantine: str | None = None, available_now: bool = True, promoted: list | None = None):
    """Raw CSV objects -> conformed Parquet rows with lineage and row hash (append-only).

    The file source's log opens only files not seen before; every micro-batch
    goes through ``promote_batch``, as a batch run does, so both may share a
    zone.  Without ``ingest_ts`` each micro-batch is stamped with its own time.
    Records that do not parse go to ``quarantine`` (JSON) if it is given, and are
    left out of the zone.  A batch that runs again replaces its own folder of the
    quarantine, and finds its rows in the zone.  ``promoted`` collects each batch's
    new rows.
    """
    schema, partition_cols = spec.raw_schema, spec.partition_columns
    data = [f for f in schema.fields if f.name not in partition_cols]
    full = T.StructType(text_schema(T.StructType(data)).fields + [schema[c] for c in partition_cols])
    stream = with_landing(spark.readStream.schema(full).option("header", True).option("basePath", raw).csv(raw))

    def each(batch: DataFrame, number: int) -> None:
        landed = stored(parsed(batch, T.StructType(data)), "landed")        # the new files are read once
        if quarantine is not None:
            bad = landed.where(F.col(CORRUPT).isNotNull()).select(*partition_cols, CORRUPT, FAULTS, F.col("_file").alias("source_file"))
            write_batch(bad, quarantine, stream_id(spark, checkpoint), number, "json")
        good = landed.where(F.col(CORRUPT).isNull()).select(*schema.fieldNames(), "_landed", "_file")
        stamp = ingest_ts or dt.datetime.now(dt.timezone.utc)
        new = promote_batch(good, conformed, stamp, batch_id, mode, spec)
        if promoted is not None:
            promoted.append(new)

    return _run(stream.writeStream.foreachBatch(each), checkpoint, available_now)


def copy_objects(spark: SparkSession, source: str, sink: str, checkpoint: str, glob: str | None = None, available_now: bool = True):
    """Copy every not-yet-seen object of a folder under its own key: rows (key, modified, content) in ``sink``.

    The key is the path below ``source``, so promoted objects keep it.  A repeated
    batch replaces its own folder; another query's batch (a lost log) finds the
    keys in the parts of the sink that it touches.
    """
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema(
        "path string, modificationTime timestamp, length long, content binary")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    objects = reader.load(source).select(relative_key(F.col("path"), source).alias("key"), F.col("modificationTime").alias("modified"), "content")

    def each(batch: DataFrame, number: int) -> None:
        promote.copy_new_objects(batch, sink, stream=stream_id(spark, checkpoint), batch=number)

    return _run(objects.writeStream.foreachBatch(each), checkpoint, available_now)


def snapshot_refresh_batch(batch: DataFrame, conformed: str, curated: str, schema: T.StructType,
                           spec: DatasetSpec = OHLCV_DAILY) -> None:
    """Rebuild the curated snapshot of every (exchange, date) touched by ``batch``.

    The touched pairs (bounded by the calendar) drive a partition-pruned
    re-read of the conformed zone; latest-wins runs over all ingests of those
    dates; dynamic partition overwrite replaces only them.  (A semi join with
    the batch would not prune: with no predicate on the batch side Catalyst
    sees no benefit in dynamic partition pruning and scans every date.)
    """
    pairs = touched_partitions(batch, spec.partition_columns)
    if pairs:
        rows = read_zone(batch.sparkSession, conformed, schema, pairs, spec.partition_columns)
        curate.build_snapshots(rows, curated, spec.business_key, spec.partition_columns)


def snapshot_refresh(spark: SparkSession, conformed: str, curated: str, checkpoint: str,
                     schema: T.StructType, available_now: bool = True, spec: DatasetSpec = OHLCV_DAILY):
    stream = spark.readStream.schema(schema).option("basePath", conformed).parquet(conformed)

    def each(batch: DataFrame, batch_id: int) -> None:
        snapshot_refresh_batch(batch, conformed, curated, schema, spec)

    return _run(stream.writeStream.foreachBatch(each), checkpoint, available_now)


def heartbeat_stream(spark: SparkSession, sink: str, checkpoint: str, rows_per_second: int = 1,
                     available_now: bool = False, trigger_seconds: int = 60):
    """One heartbeat line per tick (``yyyy-MM-dd HH:mm:ss AEDT|AEST``) to a text sink."""
    from ..functions.columns import local_time, local_tz_abbreviation
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    lines = ticks.select(F.concat(F.date_format(local_time("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit(" "),
                                  local_tz_abbreviation("timestamp")).alias("value"))
    return _run(lines.writeStream.format("text").option("path", sink), checkpoint, available_now,
                trigger_seconds=trigger_seconds)

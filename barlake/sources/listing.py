"""Object listings as tables: partition values from paths, inventories, footprints, text objects.

A listing (``files.list_objects``) is a scan of file metadata only; everything
here is an expression or an aggregate over it, so a zone's freshness or size
costs no read of its contents.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import list_objects, path_exists, relative_key

#: Folder value that stands for a null partition value.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def partition_value(path: Column, name: str, dtype: str = "string") -> Column:
    """Value of the ``name=...`` folder of a path, unescaped and cast; null if there is none or it does not parse."""
    raw = F.regexp_extract(path, f"(?:^|/){re.escape(name)}=([^/]*)/", 1)
    text = F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B"))        # a plus sign in a folder name is itself
    return F.when((raw != "") & (raw != NULL_PARTITION), text).try_cast(dtype)


def with_partition_values(listing: DataFrame, columns: dict[str, str], path: str = "path") -> DataFrame:
    """The listing with a column per folder level of ``columns`` (name -> type)."""
    return listing.select("*", *[partition_value(F.col(path), name, dtype).alias(name) for name, dtype in columns.items()])


def list_partitions(spark, base: str, columns: dict[str, str], glob: str | None = None) -> DataFrame:
    """Objects below ``base`` (path, key, modificationTime, length) with their partition values; no rows where it does not exist."""
    if not path_exists(spark, base):
        fields = ", ".join(f"`{name}` {dtype}" for name, dtype in columns.items())
        return spark.createDataFrame([], f"path string, modificationTime timestamp, length long, key string, {fields}")
    listing = list_objects(spark, base, glob=glob)
    # file paths are URIs, the base may lack its scheme
    return with_partition_values(listing.withColumn("key", relative_key(F.col("path"), base)), columns)


def object_folder(key: Column) -> Column:
    """The folder part of an object key."""
    return F.regexp_replace(key, "/[^/]*$", "")


def footprint(listing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Objects, bytes, largest and mean object per partition (one aggregate of metadata)."""
    return listing.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("objects"), F.sum("length").alias("bytes"), F.max("length").alias("largest"),
        F.try_divide(F.sum("length"), F.count(F.lit(1))).alias("mean_bytes"))


def write_text_objects(lines: DataFrame, path: str, folder_cols: Sequence[str], order: Sequence[str], value: str = "value", mode: str = "append") -> None:
    """One text object per folder: the folder's lines in ``order``.

    All lines of a folder meet in one task, so folders are to be of bounded
    size: add a slice column where one may grow.
    """
    rows = lines.repartition(*folder_cols).sortWithinPartitions(*folder_cols, *order)
    rows.select(*folder_cols, F.coalesce(F.col(value), F.lit("")).alias("value")).write.mode(mode).partitionBy(*folder_cols).text(path)

"""Small helpers shared by the operators: settings, lineage cuts, internal column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: White space between words, as a Java/RE2 character class body and as bytes.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

#: Arrow batches handed to Python hold at most so many rows and bytes, whatever the texts' lengths.
BATCH_ROWS = 4096
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by rows and bytes, so that long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the cluster's shared folder and read back: a lineage cut that any executor can read."""
    return stored_path(df, name)[0]


def stored_path(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stored``, and the folder, for results that another one replaces (see ``drop_stored``)."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_stored(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, so that rounds and stages don't add up on the shared disk."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def own_name(df: DataFrame, name: str) -> str:
    """``name`` if ``df`` has no such column (by any case), else a fresh one: added columns never clash."""
    taken = {c.lower() for c in df.columns}
    return name if name.lower() not in taken else f"{name}_{uuid.uuid4().hex[:8]}"


def absent(df: DataFrame, column: str) -> None:
    """Raises if ``df`` has a column of that name already."""
    if column.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {column!r} already")


def each_of(rows: DataFrame, n: str, place: str) -> DataFrame:
    """A row for each place from 0 to ``n`` - 1, by two short explosions, so that no row ever holds an array of ``n``."""
    root = F.ceil(F.sqrt(n)).cast("long")
    rows = rows.withColumn("_side", root).withColumn("_high", F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / root) - 1)))
    rows = rows.withColumn("_low", F.explode(F.sequence(F.lit(0), F.col("_side") - 1))).withColumn(place, F.col("_high") * F.col("_side") + F.col("_low"))
    return rows.where(F.col(place) < F.col(n)).drop("_side", "_high", "_low")


def crc32_text(c: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes of a text (null counts as no bytes)."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for rows whose crc32(doc_id as text) mod ``folds`` is ``fold`` (a null id counts as the empty text)."""
    return crc32_text(doc_id) % F.lit(folds) == F.lit(fold)


def unit(h: Column) -> Column:
    """A 64-bit hash as a double strictly between 0 and 1 (its upper 52 bits, centred)."""
    return (F.shiftrightunsigned(h, 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))

"""File sources and sinks of the three zones (any Hadoop-compatible path).

Layout (hive-style, Spark-written):
  raw        <raw>/tabular/<dataset>/exchange=X/trade_date=D/part-*.csv
  conformed  <conformed>/tabular/<dataset>/exchange=X/trade_date=D/part-*.parquet
  curated    <curated>/tabular/<dataset>/exchange=X/trade_date=D/part-*.parquet

Partition values are read with the declared types (no inference), so a
ticker such as ``360`` or ``NA`` stays text.  Files landed by other tools
that carry every column inside the row *and* in the path are read with
``recursiveFileLookup`` so Spark does not drop the in-file columns.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import CONFORMED_SCHEMA, OHLCV_DAILY, RAW_BAR_SCHEMA, DatasetSpec

#: Column of a record that does not parse, and that of the names of the columns at fault.
CORRUPT, FAULTS = "unparsed_record", "unparsed_columns"

#: Hash of a row's business key.  Object keys all begin alike, so rows are sorted by it first.
OBJECT_HASH = "_object_hash"


# --- ticker universe ----------------------------------------------------------

def read_ticker_lines(spark: SparkSession, path: str, column: str = "ticker") -> DataFrame:
    """Lines of a ticker list with their position (file order), one CSV field per line.

    The field is the one whose header names ``column`` (case and spaces
    ignored); without such a header it is the first field.  Fields may be quoted
    and hold commas then.  The header line itself is dropped later by ``ticker_universe``.  ``monotonically_increasing_id``
    follows partition then row order, i.e. file order, without moving the
    file through one task.
    """
    lines = spark.read.text(path)
    first = lines.first()
    names = [c.strip().lower() for c in next(csv.reader([first["value"]]), [])] if first else []
    idx = names.index(column) if column in names else 0
    fields = ", ".join(f"f{i} string" for i in range(idx + 1))
    return lines.select(F.from_csv("value", F.lit(fields)).getField(f"f{idx}").alias("value"),
                        F.monotonically_increasing_id().alias("pos"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise RuntimeError(f"{what} is empty or invalid")
    return df


# --- raw CSV ----------------------------------------------------------------

def _data_schema(schema: T.StructType, partition_cols) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in partition_cols])


def overwrite_raw_objects(df: DataFrame, path: str, key_cols=("exchange", "trade_date", "ticker")) -> None:
    """Land bars as one object per ticker and date, replacing exactly the objects that ``df`` holds.

    Each object is a folder ``exchange=X/trade_date=D/ticker=T``; dynamic partition
    overwrite leaves all other objects as they are.  Read it with
    ``read_raw_csv(partition_cols=key_cols)``.
    """
    (df.hint("rebalance", *key_cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*key_cols).option("header", True).csv(path))


def write_raw_csv(df: DataFrame, path: str, partition_cols=("exchange", "trade_date"),
                  mode: str = "append") -> None:
    """Land bars as CSV under hive-style date folders.

    The raw zone is append-only: a date folder holds many tickers, so
    replacing a folder would drop other tickers' objects.  A re-landed bar
    is a newer version of the same logical object (see ``current_raw_objects``).
    """
    (df.hint("rebalance", *partition_cols).write.mode(mode).partitionBy(*partition_cols)
     .option("header", True).csv(path))


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_BAR_SCHEMA,
                 partition_cols=("exchange", "trade_date"), landed: bool = False) -> DataFrame:
    """Raw rows with the declared schema; a record that does not parse raises (see ``read_raw_csv_quarantine``).

    ``landed=False``: Spark-written layout, key columns come from the path.
    ``landed=True``: files with all columns inside each row under hive-style
    folders; columns bind by position, so 11-column files (no ``adj_close``)
    and 12-column files mix with ``adj_close`` null for the former.
    """
    reader = spark.read.option("header", True)
    if landed:
        texts, data = reader.schema(text_schema(schema)).option("recursiveFileLookup", True).csv(path), schema
    else:
        data = _data_schema(schema, partition_cols)
        full = T.StructType(text_schema(data).fields + [schema[c] for c in partition_cols])
        texts = reader.schema(full).option("basePath", path).csv(path)
    rows = parsed(texts, data)
    bad = F.raise_error(F.concat(F.lit("raw record does not parse ("), F.col(FAULTS), F.lit("): "), F.col(CORRUPT)))
    return rows.where(F.when(F.col(CORRUPT).isNotNull(), bad.cast("boolean")).otherwise(F.lit(True))).select(*schema.fieldNames())


def with_landing(raw: DataFrame) -> DataFrame:
    """A file scan with each row's file and landing time."""
    return raw.select("*", F.col("_metadata.file_modification_time").alias("_landed"), F.col("_metadata.file_path").alias("_file"))


def with_object_hash(df: DataFrame, spec: DatasetSpec = OHLCV_DAILY) -> DataFrame:
    """The rows with ``OBJECT_HASH`` of their business key."""
    return df.withColumn(OBJECT_HASH, F.xxhash64(*spec.business_key))


def object_columns(spec: DatasetSpec = OHLCV_DAILY) -> list[str]:
    """The columns by which versions of an object are grouped and joined, the hash first."""
    return [OBJECT_HASH, *spec.business_key, "source_object_key"]


def current_raw_objects(raw: DataFrame, spec: DatasetSpec = OHLCV_DAILY) -> DataFrame:
    """Raw rows as logical objects: one current version per business key.

    ``source_object_key`` is the object key of the row
    (``tabular/<dataset>/exchange=X/trade_date=D/ticker=T.csv`` for bars); when a
    row was landed more than once, the most recently landed file wins, as an
    overwritten object would.  ``raw`` comes straight from a file scan or through ``with_landing``.
    The rows leave the aggregate spread and sorted by ``object_columns``, so that a join by these moves them no more.
    """
    from ..functions.keys import object_key
    rows = raw if "_landed" in raw.columns else with_landing(raw)
    raw, key = rows.drop("_landed", "_file"), object_columns(spec)
    rest = [c for c in raw.columns if c not in key]
    keyed = with_object_hash(rows.withColumn("source_object_key", object_key(spec)), spec)
    cur = keyed.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_landed", "_file")).alias("_v"))
    return cur.select(*key, *[F.col("_v." + c).alias(c) for c in rest]).select(*raw.columns, "source_object_key", OBJECT_HASH)


def text_schema(schema: T.StructType) -> T.StructType:
    """The same columns as text, so that a reader of it never drops or nulls what does not parse."""
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])


def parsed(texts: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns of ``schema`` cast to their types, other columns unchanged, ``CORRUPT`` and ``FAULTS``.

    If some texts of a record do not parse, ``CORRUPT`` holds all of its texts,
    comma-joined, and ``FAULTS`` the names of those columns, comma-joined; else both
    are null.  A missing last column (11-column files) is null, not an error.
    """
    wrong = [F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.lit(f.name)) for f in schema.fields]
    faults = F.concat_ws(",", *wrong)
    bad = faults != ""
    record = F.concat_ws(",", *[F.coalesce(F.col(f.name), F.lit("")) for f in schema.fields])
    typed = {f.name: f.dataType for f in schema.fields}
    return texts.select(*[F.col(c).try_cast(typed[c]).alias(c) if c in typed else F.col(c) for c in texts.columns], F.when(bad, record).alias(CORRUPT), F.when(bad, faults).alias(FAULTS))


def read_raw_csv_quarantine(spark: SparkSession, path: str, schema: T.StructType = RAW_BAR_SCHEMA):
    """(good, bad) split of landed raw CSV: records that do not parse go to quarantine."""
    texts = spark.read.option("header", True).option("recursiveFileLookup", True).schema(text_schema(schema)).csv(path)
    df = parsed(texts.withColumn("source_object_key", F.col("_metadata.file_path")), schema)
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT, FAULTS)
    bad = df.where(F.col(CORRUPT).isNotNull())
    return good, bad


# --- conformed / curated Parquet ----------------------------------------------

def write_parquet_partitions(df: DataFrame, path: str, mode: str,
                             partition_cols=("exchange", "trade_date"), max_records: int = 5_000_000) -> None:
    """Partitioned Parquet write: rows of a date are brought together into few files, a large date is split (rebalance)."""
    (df.hint("rebalance", *partition_cols).write.mode(mode).partitionBy(*partition_cols)
     .option("maxRecordsPerFile", max_records).parquet(path))


def touched_partitions(df: DataFrame, columns=OHLCV_DAILY.partition_columns) -> list[tuple]:
    """The partitions of a batch, such as (exchange, trade_date): one per exchange and day, bounded by the calendar."""
    return [tuple(r) for r in df.select(*columns).distinct().collect()]


def in_partitions(pairs, columns=OHLCV_DAILY.partition_columns) -> Column:
    """Static partition filter: values of the last column by those of the others."""
    by_head: dict = {}
    for *head, last in pairs:
        by_head.setdefault(tuple(head), []).append(last)
    cond = F.lit(False)
    for head, lasts in by_head.items():
        one = F.col(columns[-1]).isin(lasts)
        for c, value in zip(columns, head):
            one = (F.col(c) == F.lit(value)) & one
        cond = cond | one
    return cond


def read_zone(spark: SparkSession, path: str, schema: T.StructType = CONFORMED_SCHEMA,
              pairs=None, columns=OHLCV_DAILY.partition_columns) -> DataFrame:
    """Conformed/curated scan with declared schema; ``pairs`` (values of ``columns``) prune partitions."""
    df = spark.read.schema(schema).option("basePath", path).parquet(path)
    return df if pairs is None else df.where(in_partitions(pairs, columns))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder with all it holds; False if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def curated_scan(spark: SparkSession, path: str, schema: T.StructType = CONFORMED_SCHEMA) -> DataFrame:
    """Curated snapshots of all dates as one typed table (key columns text, dates as dates)."""
    from ..functions.columns import to_text
    df = read_zone(spark, path, schema)
    return df.select(*[to_text(c).alias(c) if c in ("dataset_id", "exchange", "ticker")
                       else F.col(c) for c in schema.fieldNames()])


# --- object listings ------------------------------------------------------------

def list_objects(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Object listing ``path, modificationTime, length`` (file contents are not read)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "modificationTime", "length")


def require_objects(listing: DataFrame, what: str) -> DataFrame:
    """The listing itself; raises if it is empty."""
    return require_rows(listing, what)


def relative_key(path_col, base: str):
    base = base.rstrip("/") + "/"
    return F.regexp_replace(path_col, "^(file:)?" + _escape(base.replace("file:", "")), "")


def _escape(s: str) -> str:
    import re
    return re.escape(s)


# --- heartbeat text -----------------------------------------------------------

def newest_body(objects: DataFrame, key: str = "key", time: str = "modified") -> DataFrame:
    """The most recently modified object with its body (ties: largest key).

    The choice is made on key and time alone (one aggregate); only the chosen
    object's body is read on.
    """
    top = objects.agg(F.max(F.struct(time, key)).alias("_top")).select(F.col(f"_top.{key}").alias("_key"))
    return objects.join(top, F.col(key) == F.col("_key"), "left_semi")


def read_text_objects(spark: SparkSession, path: str) -> DataFrame:
    """Text objects with their key and modification time (for newest-object reads)."""
    return spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("modificationTime"),
        F.col("value"))

"""Wide export of a long matrix: pivoted column blocks with declared schemas, and their manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .positions import with_positions

#: Columns of a block.
BLOCK_COLUMNS = 256
MANIFEST = "block int, file_schema string, rows long, columns int"


def _column(place: int) -> str:
    """The name in the files of a block's column at ``place``; the manifest has the declared one."""
    return f"_{place}"


def _field(name: Column, dtype: T.DataType) -> Column:
    """A field of a schema's JSON text; a series without a name has the name null."""
    named = F.when(name.isNull(), F.lit('"name":null')).otherwise(F.expr("substring(_json, 2, length(_json) - 2)"))
    return F.concat(F.lit("{"), named, F.lit(f',"type":{dtype.json()},"nullable":true,"metadata":{{}}}}'))


def _manifest(names: DataFrame, index: T.StructField, column: str, value: T.DataType, n_rows: int) -> DataFrame:
    """A row per block; a block's names are brought together, never all."""
    first = json.dumps({"name": index.name, "type": index.dataType.jsonValue(), "nullable": True, "metadata": {}})
    fields = names.withColumn("_json", F.to_json(F.struct(F.col(column).cast("string").alias("name")))).select(
        "block", column, F.struct("_n", _field(F.col(column), value).alias("field")).alias("_f"))
    of_block = F.array_join(F.transform(F.sort_array(F.collect_list("_f")), lambda f: f["field"]), ",")
    return fields.groupBy("block").agg(
        F.concat(F.lit('{"type":"struct","fields":[' + first + ","), of_block, F.lit("]}")).alias("file_schema"),
        F.lit(n_rows).cast("long").alias("rows"), F.count(column).cast("int").alias("columns"))


def export_wide(matrix: DataFrame, path: str, index: str = "trade_date", column: str = "ticker", value: str = "ret_1d", block_columns: int = BLOCK_COLUMNS) -> DataFrame:
    """Write the long matrix (index, column, value) as wide blocks; returns their manifest.

    Columns are discovered and numbered in order; each block of ``block_columns``
    of them is written as ``block=<n>`` with all index values, so that the blocks
    side by side are the matrix.  All blocks are pivoted and written by one job,
    whatever their number: long rows are laid out by block and pivoted by the
    place in it.  One write has one schema, so the files name a block's columns
    by their places, and the manifest declares the names (see ``read_block``).
    A null index value or name is kept, but not counted in the manifest.
    """
    spark = matrix.sparkSession
    at = F.col("_n") - 1
    names = with_positions(matrix.select(column).distinct(), [column], "_n").select(
        column, "_n", F.floor(at / block_columns).cast("int").alias("block"), (at % block_columns).cast("int").alias("_place"))
    names = stored(names, "wide-names")
    n_names, n_rows = names.count(), matrix.select(F.count_distinct(index)).first()[0]
    if n_names:
        blocks, width = -(-n_names // block_columns), min(n_names, block_columns)
        numbered = names.select(F.col(column).alias("_name"), "block", "_place")
        cells = matrix.join(numbered, F.col(column).eqNullSafe(F.col("_name"))).select("block", index, "_place", value)
        days = matrix.select(index).distinct().select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), index,
                                                      F.lit(None).cast("int").alias("_place"), F.lit(None).cast(matrix.schema[value].dataType).alias(value))
        pivoted = cells.unionByName(days).repartition("block").groupBy("block", index).pivot("_place", list(range(width))).agg(F.first(value, ignorenulls=True))
        (pivoted.select("block", index, *[F.col(f"`{i}`").alias(_column(i)) for i in range(width)])
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(path))
    _manifest(names, matrix.schema[index], column, matrix.schema[value].dataType, n_rows).write.mode("overwrite").json(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def _in_files(entry) -> T.StructType:
    """The schema of a block's files."""
    index, *fields = json.loads(entry["file_schema"])["fields"]
    return T.StructType.fromJson({"type": "struct", "fields": [index, *[{**f, "name": _column(i)} for i, f in enumerate(fields)]]})


def read_block(spark: SparkSession, path: str, entry) -> DataFrame:
    """One block by its manifest entry, with the schema declared there (a series without a name as '')."""
    names = [f["name"] or "" for f in json.loads(entry["file_schema"])["fields"]]
    return spark.read.schema(_in_files(entry)).parquet(f"{path}/block={entry['block']}").toDF(*names)


def read_long(spark: SparkSession, path: str, index: str = "trade_date", column: str = "ticker", value: str = "ret_1d") -> DataFrame:
    """The blocks unpivoted to the long matrix, in one scan; empty cells are left out."""
    manifest = read_manifest(spark, path)
    widest = manifest.orderBy("block").first()                 # all blocks but the last are as wide
    if widest is None:
        return spark.createDataFrame([], f"{index} date, {column} string, {value} double")
    in_files = _in_files(widest)
    wide = spark.read.schema(T.StructType([*in_files, T.StructField("block", T.IntegerType())])).option("basePath", path).parquet(f"{path}/block=*")
    declared = F.from_json("file_schema", F.lit("fields array<struct<name string>>")).getField("fields").getField("name")
    named = manifest.select("block", F.slice(declared, 2, len(in_files) - 1).alias("_names"))
    cells = F.explode(F.arrays_zip(F.col("_names").alias("name"), F.array(*[F.col(c) for c in in_files.names[1:]]).alias("value")))
    cell = wide.join(named, "block").select(F.col(in_files.names[0]).alias(index), cells.alias("_cell"))
    return cell.select(index, F.col("_cell")["name"].alias(column), F.col("_cell")["value"].alias(value)).where(F.col(value).isNotNull())


def matrix_shape(manifest: DataFrame) -> DataFrame:
    """rows and columns of the wide matrix, from its manifest."""
    return manifest.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("columns"), F.lit(0)).alias("columns"))

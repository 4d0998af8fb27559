"""Ordinal positions of a global order, without a window over all rows."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
_ROW_BITS = 33


def with_positions(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """``df`` with each row's place (from 1) in the given order.

    Rows are range partitioned and sorted, so partition k holds only rows that
    come before those of partition k + 1; a row's place is its place in its
    partition plus the rows of the partitions before.  The numbered rows are
    written once, so that counts and rows come from the same partitions; only
    the counts, one row per partition, are summed up in one task.  Ties of the
    order come in some fixed order: give a full key where that matters.
    """
    in_order = df.repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    rows = stored(in_order.select("*", F.spark_partition_id().alias("_part"), row.alias("_row")), "positions")
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)      # one row per partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(offsets, "_part").select(*df.columns, (F.col("_before") + F.col("_row") + 1).alias(name))

"""Connected components by alternating stars, on Spark throughout.

Each round links every node's larger neighbours to the smallest node it sees
(large star), then every node's smaller neighbours to the smallest of them
(small star); rounds end when the edges no longer change, and then each
component is a star around its smallest node.  A node with very many
neighbours is only ever grouped by ``min`` (combined before the shuffle) or
joined (which Spark splits), never collected.  Edges are written to the shared
folder after each round, so a lost executor costs one round at most; the round
before is deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored_path


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.xxhash64("v", "u") % 1_000_003).cast("long"))).first()
    return tuple(row)


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("_x"), F.least("x", "m").alias("m"))
    large = both.where("y > x").join(least, F.col("x") == F.col("_x")).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
    small = large.join(least, F.col("u") == F.col("_u"))
    return (small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(small.where("v = m").select("u", "v")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (two long columns); component is the smallest node that it reaches.

    Edges with a null end and loops are dropped; without edges the result is empty.
    """
    a, b = edges.columns
    e = (edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct())
    e, path = stored_path(e, "edges")
    before = _signature(e)
    while before[0]:
        last = path
        e, path = stored_path(_round(e), "edges")
        after = _signature(e)
        drop_stored(edges.sparkSession, last)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

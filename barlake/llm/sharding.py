"""Sharding by weighted rendezvous hashing of stable record keys.

Each (key, shard) pair has a score -w / ln(u) with u from a 64-bit hash of
both; a key goes to the shard of its highest score.  The scores of the other
shards don't depend on a new one, so a new shard takes keys only into itself,
and a removed shard gives up only its own; weights scale a shard's share.

Places (slots) inside a shard come from counts: rows are first put into
hash-ordered bins within their shard, the bins' counts are summed up to
offsets, and only rows of one bin are ever ordered together.  Equal rows are
counted before anything is shuffled, so one key may hold any share of the rows.

Edge cases: a null key is hashed as a key of its own; repeated rows get
places of their own; texts of any length count whole; an empty table stays
empty; columns of any name are carried through, and an added column that exists
already raises.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import absent, crc32_text, each_of, unit

#: Bins per shard; a bin of 10 billion rows in 16 shards holds about 150,000 of them.
BINS = 4096


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based int) of a key among ``len(weights)`` weighted shards."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("each shard needs a positive weight")
    k = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    best = None
    for i, w in enumerate(weights):
        score = F.lit(float(-w)) / F.log(unit(F.xxhash64(k, F.lit(i))))
        entry = F.struct(score.alias("score"), F.lit(-i).alias("shard"))   # equal scores: the lower shard
        best = entry if best is None else F.greatest(best, entry)
    return (-best["shard"]).cast("int")


def rendezvous(df: DataFrame, key: str, weights: Sequence[float], column: str = "shard") -> DataFrame:
    """``df`` with the shard of each row's key; a narrow map, nothing is shuffled."""
    absent(df, column)
    return df.withColumn(column, rendezvous_shard(F.col(key), weights))


def number_slots(df: DataFrame, shard: str = "shard", slot: str = "slot", bins: int = BINS) -> DataFrame:
    """Distinct or repeated narrow rows with a gapless place from 0 in their shard.

    All columns take part in the order (hash first), so reruns agree.
    """
    absent(df, slot)
    cols = df.columns
    order = F.xxhash64(*[F.col(c) for c in cols])
    counted = (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
               .withColumn("_order", order).withColumn("_bin", F.pmod(F.shiftrightunsigned("_order", 20), F.lit(bins)).cast("int")))
    counted = counted.repartition(shard, "_bin")
    in_bins = counted.groupBy(shard, "_bin").agg(F.sum("_copies").alias("_rows"))
    before = Window.partitionBy(shard).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = in_bins.select(F.col(shard).alias("_s"), F.col("_bin").alias("_b"),
                             F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(shard, "_bin").orderBy("_order", *cols).rowsBetween(Window.unboundedPreceding, -1)
    placed = (counted.withColumn("_before", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
              .join(offsets, (F.col(shard).eqNullSafe(F.col("_s"))) & (F.col("_bin") == F.col("_b"))))
    return each_of(placed, "_copies", "_place").select(*cols, (F.col("_offset") + F.col("_before") + F.col("_place")).alias(slot))


def shard_plan(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, by its doc_id alone."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), crc32_text(F.col("text")).alias("text_crc32"))
    narrow = rendezvous(rendezvous(narrow, "doc_id", [1.0] * shards), "doc_id", [1.0] * (shards + 1), "grown_shard")
    return number_slots(narrow).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

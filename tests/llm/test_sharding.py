import struct
import zlib
from collections import Counter

import pytest
import xxhash
from helpers import awkward_texts, documents
from pyspark.sql import functions as F

from barlake.llm import sharding as S


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _shard(key, n):
    """The shard by brute force: Spark's xxhash64 of (text, int) is XXH64 of the text, seeded 42, as the seed of the int's."""
    name = "\u0000null" if key is None else str(key)
    best = []
    for i in range(n):
        h = _int_hash(i, xxhash.xxh64_intdigest(name.encode(), seed=42))
        best.append((((h >> 12) + 0.5) / (1 << 52), -i))
    return -max(best)[1]


def _int_hash(i, seed):
    return xxhash.xxh64_intdigest(struct.pack("<i", i), seed=seed)


def test_plan_matches_brute_force(spark):
    rows = [*awkward_texts(), *((100 + i, f"text {i % 9}") for i in range(3000))]
    docs = documents(spark, [(i, t, 7) for i, t in rows], "doc_id long, text string, size int")
    got = S.shard_plan(docs, 16).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", _shard(i, 16), _shard(i, 17)) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for s in range(16):
        slots = sorted(r.slot for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r["shard"], 16) for r in got)
    again = S.shard_plan(docs.repartition(7), 16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_weights_and_removed_shards(spark):
    docs = spark.range(30_000).withColumnRenamed("id", "doc_id")
    n = dict(S.rendezvous(docs, "doc_id", [1.0, 2.0, 1.0]).groupBy("shard").count().collect())
    assert abs(n[1] / 30_000 - 0.5) < 0.02 and abs(n[0] / n[2] - 1) < 0.1
    both = S.rendezvous(S.rendezvous(docs, "doc_id", [1.0, 1.0, 1.0]), "doc_id", [1.0, 1.0], "fewer")
    assert both.where("shard < 2 and fewer <> shard").count() == 0
    with pytest.raises(ValueError):
        S.rendezvous_shard(F.col("doc_id"), [1.0, 0.0])


def test_one_key_may_hold_most_rows(spark):
    docs = documents(spark, [(5, "same")] * 2000 + [(i, "x") for i in range(500)])
    got = S.shard_plan(docs, 16).collect()
    hot = [r for r in got if r["shard"] == _shard(5, 16)]
    assert len(got) == 2500 and sorted(r.slot for r in hot) == list(range(len(hot)))
    assert S.shard_plan(documents(spark, []), 16).collect() == []
    plan = S.shard_plan(docs, 16)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_added_columns_must_be_new(spark):
    df = spark.createDataFrame([(1, 2)], "doc_id long, Slot long")
    with pytest.raises(ValueError):
        S.number_slots(df.withColumn("shard", F.lit(0)))
    with pytest.raises(ValueError):
        S.rendezvous(df, "doc_id", [1.0], "SLOT")

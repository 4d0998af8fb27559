"""Idempotent incremental promotion: re-runs add nothing; new objects touch only their dates."""
import datetime as dt

from pyspark.sql import functions as F

from barlake.sources.files import write_raw_csv
from barlake.spec import CONFORMED_SCHEMA, RAW_BAR_SCHEMA
from barlake.streaming import jobs

D = dt.date
TS = dt.datetime(2025, 1, 1, 9)


def _bars(spark, rows):
    return spark.createDataFrame(
        [("market_ohlcv_daily", "ASX", t, t + ".AX", "AUD", d, c, c, c, c, 10, c) for t, d, c in rows],
        RAW_BAR_SCHEMA)


def test_raw_to_conformed_is_incremental(spark, tmp_dir):
    raw, conf, ck = f"{tmp_dir}/raw", f"{tmp_dir}/conformed", f"{tmp_dir}/_ck"
    write_raw_csv(_bars(spark, [("BHP", D(2025, 1, 2), 1.0), ("360", D(2025, 1, 2), 2.0)]), raw, mode="append")
    jobs.raw_to_conformed(spark, raw, conf, ck, TS, "b1")
    jobs.raw_to_conformed(spark, raw, conf, ck, TS, "b2")  # nothing new
    out = spark.read.parquet(conf)
    assert out.count() == 2 and out.select("ingest_batch_id").distinct().count() == 1
    assert set(r["ticker"] for r in out.collect()) == {"BHP", "360"}
    write_raw_csv(_bars(spark, [("CBA", D(2025, 1, 3), 3.0)]), raw, mode="append")
    jobs.raw_to_conformed(spark, raw, conf, ck, TS, "b3")
    out = spark.read.parquet(conf)
    assert out.count() == 3
    assert [r["ingest_batch_id"] for r in out.where(F.col("ticker") == "CBA").collect()] == ["b3"]
    assert all(r["source_object_key"].startswith("tabular/market_ohlcv_daily/exchange=ASX/trade_date=") for r in out.collect())


def test_snapshot_refresh_rewrites_touched_dates_only(spark, tmp_dir):
    conf, cur, ck = f"{tmp_dir}/conformed", f"{tmp_dir}/curated", f"{tmp_dir}/_ck"
    raw = f"{tmp_dir}/raw"
    write_raw_csv(_bars(spark, [("BHP", D(2025, 1, 2), 1.0), ("BHP", D(2025, 1, 3), 2.0)]), raw, mode="append")
    jobs.raw_to_conformed(spark, raw, conf, f"{tmp_dir}/_ck_raw", TS, "b1")
    schema = CONFORMED_SCHEMA
    jobs.snapshot_refresh(spark, conf, cur, ck, schema)
    snap = spark.read.parquet(cur)
    assert snap.count() == 2
    # a restatement of 2025-01-03 lands later: only that date is rewritten, latest wins
    write_raw_csv(_bars(spark, [("BHP", D(2025, 1, 3), 9.0)]), raw, mode="append")
    jobs.raw_to_conformed(spark, raw, conf, f"{tmp_dir}/_ck_raw", dt.datetime(2025, 1, 5), "b2", mode="by_content")
    jobs.snapshot_refresh(spark, conf, cur, ck, schema)
    snap = {r["trade_date"]: r["close"] for r in spark.read.schema(schema).parquet(cur).collect()}
    assert snap == {D(2025, 1, 2): 1.0, D(2025, 1, 3): 9.0}


def test_copy_promote_twice_adds_nothing(spark, tmp_dir):
    src, sink, ck = f"{tmp_dir}/src", f"{tmp_dir}/sink", f"{tmp_dir}/_ck"
    spark.range(5).write.parquet(src)
    schema = spark.read.parquet(src).schema
    jobs.copy_promote(spark, src, sink, ck, schema)
    jobs.copy_promote(spark, src, sink, ck, schema)
    assert spark.read.parquet(sink).count() == 5


def test_stream_and_batch_share_a_zone(spark, tmp_dir):
    """Each promotes what the other has not, in any order; nothing is lost, nothing doubled."""
    from barlake.plans import lake_jobs
    from barlake.spec import LakePaths
    paths = LakePaths.under(tmp_dir)
    raw, conf = paths.table("raw"), paths.table("conformed")
    write_raw_csv(_bars(spark, [("BHP", D(2025, 1, 2), 1.0)]), raw)
    jobs.raw_to_conformed(spark, raw, conf, f"{tmp_dir}/_ck", TS, "s1")
    write_raw_csv(_bars(spark, [("BHP", D(2025, 1, 3), 2.0), ("360", D(2025, 1, 2), 3.0)]), raw)
    assert lake_jobs.promote_raw(spark, paths, TS, "b1").count() == 2
    jobs.raw_to_conformed(spark, raw, conf, f"{tmp_dir}/_ck", TS, "s2")
    write_raw_csv(_bars(spark, [("360", D(2025, 1, 3), 4.0)]), raw)
    jobs.raw_to_conformed(spark, raw, conf, f"{tmp_dir}/_ck", None, "s3")
    assert lake_jobs.promote_raw(spark, paths, TS, "b2").count() == 0
    out = spark.read.schema(CONFORMED_SCHEMA).parquet(conf).collect()
    assert sorted((r["ticker"], r["trade_date"].day, r["ingest_batch_id"]) for r in out) == \
        [("360", 2, "b1"), ("360", 3, "s3"), ("BHP", 2, "s1"), ("BHP", 3, "b1")]


def test_objects_keep_their_keys(spark, tmp_dir):
    import os
    src, sink = f"{tmp_dir}/src", f"{tmp_dir}/sink"
    for key, body in (("heartbeat/a.txt", "one"), ("heartbeat/sub/b.txt", "two")):
        os.makedirs(os.path.dirname(f"{src}/{key}"), exist_ok=True)
        with open(f"{src}/{key}", "w") as f:
            f.write(body)
    jobs.copy_objects(spark, src, sink, f"{tmp_dir}/_ck")
    with open(f"{src}/heartbeat/c.txt", "w") as f:
        f.write("three")
    jobs.copy_objects(spark, src, sink, f"{tmp_dir}/_ck")
    jobs.copy_objects(spark, src, sink, f"{tmp_dir}/_other_log")        # a lost log copies nothing twice
    got = {r["key"]: bytes(r["content"]).decode() for r in spark.read.parquet(sink).collect()}
    assert got == {"heartbeat/a.txt": "one", "heartbeat/sub/b.txt": "two", "heartbeat/c.txt": "three"}
    assert spark.read.parquet(sink).count() == 3

"""One key holding a third of all rows: results stay exact, the plan combines map-side."""
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from barlake.operators import curate, quality, stats

D = dt.date


def _skewed(spark, n=30000):
    rng = np.random.default_rng(5)
    hot = n // 3
    rows = []
    for i in range(n):
        if i < hot:
            t, d = "HOT", D(2025, 1, 2)
        else:
            t, d = f"T{i % 400}", D(2025, 1, 2) + dt.timedelta(days=int(i % 50))
        ts = dt.datetime(2025, 1, 1) + dt.timedelta(seconds=int(rng.integers(0, 10_000)))
        rows.append(("d", "ASX", t, d, float(rng.integers(0, 1000)), ts, f"k{i}", f"h{i % 977}"))
    return spark.createDataFrame(rows, "dataset_id string, exchange string, ticker string, trade_date date, "
                                       "close double, ingest_ts timestamp, source_object_key string, row_hash string")


def test_hot_key_latest_wins_and_dedupe(spark):
    df = _skewed(spark).repartition(8).cache()
    pdf = df.toPandas()
    got = {(r["ticker"], r["trade_date"]): r["source_object_key"] for r in curate.latest_wins(df).collect()}
    want = (pdf.sort_values(["ingest_ts", "source_object_key", "row_hash"])
            .groupby(["ticker", "trade_date"]).tail(1))
    assert got == {(r.ticker, r.trade_date): r.source_object_key for r in want.itertuples()}
    ded = curate.exact_dedupe(df).count()
    assert ded == len(pdf.drop_duplicates(["dataset_id", "exchange", "ticker", "trade_date", "row_hash"]))
    dups = quality.duplicate_rows(df)
    hot_rows = dups.where(F.col("ticker") == "HOT").select("key_rows").distinct().collect()
    assert [r["key_rows"] for r in hot_rows] == [10000]
    plan = curate.latest_wins(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_hot_group_median(spark):
    df = _skewed(spark)
    got = {r["ticker"]: r["quantile"] for r in
           stats.exact_quantiles(df, "close", [0.5], ["ticker"]).collect()}
    pdf = df.toPandas()
    want = pdf.groupby("ticker")["close"].median()
    assert got["HOT"] == want["HOT"]
    assert all(abs(got[t] - want[t]) < 1e-12 for t in want.index)


def test_hot_date_is_written_by_several_tasks(spark, tmp_dir):
    """One date holds a third of the rows: its folder gets several files, the results are those of any other layout."""
    import os

    from barlake.sources.files import write_parquet_partitions
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    df = _skewed(spark, 90_000)
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
        write_parquet_partitions(df.repartition(24), tmp_dir + "/zone", "append")
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    hot = [f for f in os.listdir(tmp_dir + "/zone/exchange=ASX/trade_date=2025-01-02") if f.endswith(".parquet")]
    assert len(hot) > 1
    assert spark.read.parquet(tmp_dir + "/zone").count() == 90_000

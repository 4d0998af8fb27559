"""Scheduled jobs end to end on a small lake (few dates, so local folder creation stays cheap)."""
import datetime as dt

from pyspark.sql import functions as F

from barlake.operators import control
from barlake.plans import lake_jobs
from barlake.sources.files import read_raw_csv, read_zone
from barlake.spec import CONFORMED_SCHEMA, LakePaths

D = dt.date


def _vendor(spark, tickers, start, days, bump=0.0):
    rows = []
    for t in tickers:
        for i in range(days):
            d = start + dt.timedelta(days=i)
            px = 10.0 + i + bump
            rows.append((t, d.isoformat(), px, px + 1, px - 1, px + 0.5, px + 0.4, 100.0 + i))
    return spark.createDataFrame(rows, "ticker string, Date string, Open double, High double, Low double, "
                                       "Close double, `Adj Close` double, Volume double")


def test_daily_ingest_promote_and_refresh(spark, tmp_dir):
    paths = LakePaths.under(tmp_dir)
    vendor = _vendor(spark, ["BHP", "360"], D(2025, 1, 1), 6)
    lake_jobs.ingest_daily(vendor, paths, "2025-01-06", rolling_days=3)
    raw = read_raw_csv(spark, paths.table("raw"))
    assert raw.count() == 6 and raw.where(F.col("adj_close").isNotNull()).count() == 0
    assert sorted(r["trade_date"] for r in raw.select("trade_date").distinct().collect()) == \
        [D(2025, 1, 4), D(2025, 1, 5), D(2025, 1, 6)]

    assert lake_jobs.promote_raw(spark, paths, dt.datetime(2025, 1, 7), "b1").count() == 6
    assert lake_jobs.promote_raw(spark, paths, dt.datetime(2025, 1, 8), "b2").count() == 0
    assert len(lake_jobs.refresh_snapshots(spark, paths)) == 3
    assert lake_jobs.refresh_snapshots(spark, paths) == []

    # a restatement of the last day: raw file rewritten, promoted by content, only its date refreshed
    lake_jobs.ingest_daily(_vendor(spark, ["BHP"], D(2025, 1, 6), 1, bump=5.0), paths, "2025-01-06")
    assert lake_jobs.promote_raw(spark, paths, dt.datetime(2025, 1, 9), "b3", mode="by_content").count() == 1
    assert lake_jobs.refresh_snapshots(spark, paths) == [("ASX", D(2025, 1, 6))]
    snap = read_zone(spark, paths.table("curated"), CONFORMED_SCHEMA)
    assert snap.count() == 6
    last = snap.where((F.col("ticker") == "BHP") & (F.col("trade_date") == D(2025, 1, 6))).collect()[0]
    assert last["open"] == 15.0 and last["ingest_batch_id"] == "b3"


def test_backfill_resume(spark, tmp_dir):
    paths = LakePaths.under(tmp_dir)
    universe = spark.createDataFrame([("BHP", 0), ("CBA", 1), ("XYZ", 2)], "ticker string, pos long")
    state, audit = f"{tmp_dir}/state", f"{tmp_dir}/audit"
    out1 = lake_jobs.backfill(universe, _vendor(spark, ["BHP", "CBA"], D(2025, 1, 1), 2), paths, state, audit,
                              "2025-01-02", dt.datetime(2025, 1, 3))
    assert {r["ticker"]: r["status"] for r in out1.collect()} == {"BHP": "complete", "CBA": "complete",
                                                                   "XYZ": "error"}
    out2 = lake_jobs.backfill(universe, _vendor(spark, ["BHP", "CBA", "XYZ"], D(2025, 1, 1), 2), paths, state,
                              audit, "2025-01-02", dt.datetime(2025, 1, 4))
    assert [r["ticker"] for r in out2.collect()] == ["XYZ"]  # completed tickers are skipped
    st = {r["ticker"]: (r["status"], r["rows_written"]) for r in control.load_state(spark, state).collect()}
    assert st == {"BHP": ("complete", 2), "CBA": ("complete", 2), "XYZ": ("complete", 2)}
    assert [(r["ticker"], r["run_date"]) for r in control.read_audit(spark, audit).collect()] == [("XYZ", D(2025, 1, 2))]
    assert read_raw_csv(spark, paths.table("raw")).count() == 6


def test_backfill_goes_on_past_bad_rows(spark, tmp_dir):
    """A bad date or number fails its own ticker, lands nothing of it, and is retried."""
    paths = LakePaths.under(tmp_dir)
    state, audit = f"{tmp_dir}/state", f"{tmp_dir}/audit"
    universe = spark.createDataFrame([("BHP", 0), ("BAD", 1), ("NUM", 2)], "ticker string, pos long")
    rows = [("BHP", "2025-01-01", "1.5", "9007199254740993"), ("BAD", "2025-01-01", "1", "1"), ("BAD", "no date", "1", "1"), ("NUM", "2025-01-02", "x", "1")]
    vendor = spark.createDataFrame(rows, "ticker string, Date string, Close string, Volume string")
    out = {r["ticker"]: (r["status"], r["error"]) for r in
           lake_jobs.backfill(universe, vendor, paths, state, audit, "2025-01-02", dt.datetime(2025, 1, 3)).collect()}
    assert out == {"BHP": ("complete", None), "BAD": ("error", "Unparsable rows: 1"), "NUM": ("error", "Unparsable rows: 1")}
    raw = read_raw_csv(spark, paths.table("raw")).collect()
    assert [(r["ticker"], r["volume"]) for r in raw] == [("BHP", 9007199254740993)]      # no detour through double
    assert {r["ticker"] for r in control.read_audit(spark, audit, "2025-01-02").collect()} == {"BAD", "NUM"}
    assert control.read_audit(spark, audit, "2025-01-03").count() == 0
    again = lake_jobs.backfill(universe, vendor.where("ticker <> 'BAD' or Date <> 'no date'"), paths, state, audit, "2025-01-02", dt.datetime(2025, 1, 4))
    assert {r["ticker"]: r["status"] for r in again.collect()} == {"BAD": "complete", "NUM": "error"}


def test_state_survives_a_run_that_breaks_off(spark, tmp_dir):
    """What a killed run leaves (uncommitted files) changes nothing; the next run goes on from the last full state."""
    import os
    paths = LakePaths.under(tmp_dir)
    state, audit = f"{tmp_dir}/state", f"{tmp_dir}/audit"
    universe = spark.createDataFrame([("BHP", 0), ("CBA", 1)], "ticker string, pos long")
    lake_jobs.backfill(universe, _vendor(spark, ["BHP"], D(2025, 1, 1), 1), paths, state, audit, "2025-01-02", dt.datetime(2025, 1, 3))
    os.makedirs(f"{state}/_temporary/0/task_1")
    with open(f"{state}/_temporary/0/task_1/part-00000.json", "w") as f:
        f.write('{"ticker": "CBA", "status": "comp')
    assert {r["ticker"]: r["status"] for r in control.load_state(spark, state).collect()} == {"BHP": "complete", "CBA": "error"}
    assert [r["ticker"] for r in control.pending_tickers(universe, control.load_state(spark, state)).collect()] == ["CBA"]


def test_refresh_window_counts_dates(spark, tmp_dir):
    paths = LakePaths.under(tmp_dir)
    lake_jobs.ingest_daily(_vendor(spark, ["BHP"], D(2025, 1, 1), 6), paths, "2025-01-06")
    lake_jobs.promote_raw(spark, paths, dt.datetime(2025, 1, 7), "b1")
    assert lake_jobs.refresh_snapshots(spark, paths, days_back=3, as_of="2025-01-06") == [("ASX", D(2025, 1, d)) for d in (4, 5, 6)]


def test_records_that_do_not_parse_are_quarantined(spark, tmp_dir):
    import os
    paths = LakePaths.under(tmp_dir)
    lake_jobs.ingest_daily(_vendor(spark, ["BHP"], D(2025, 1, 1), 2), paths, "2025-01-02")
    folder = paths.table("raw") + "/exchange=ASX/trade_date=2025-01-02"
    with open(folder + "/landed.csv", "w") as f:
        f.write("dataset_id,ticker,vendor_symbol,currency,open,high,low,close,volume\nmarket_ohlcv_daily,BAD,BAD.AX,AUD,abc,2,1,1,10\n")
    assert os.path.exists(folder)
    assert lake_jobs.promote_raw(spark, paths, dt.datetime(2025, 1, 7), "b1").count() == 2
    bad = spark.read.json(paths.table("conformed") + "_quarantine").collect()
    assert len(bad) == 1 and "abc" in bad[0]["unparsed_record"] and bad[0]["source_file"].endswith("landed.csv")


def test_keyed_overwrite_replaces_one_object(spark, tmp_dir):
    from barlake.operators.normalise import normalise_bars
    from barlake.sources.files import overwrite_raw_objects
    from barlake.spec import RAW_BAR_SCHEMA
    path, keys = f"{tmp_dir}/raw", ("exchange", "trade_date", "ticker")
    overwrite_raw_objects(normalise_bars(_vendor(spark, ["BHP", "360"], D(2025, 1, 1), 2)), path)
    overwrite_raw_objects(normalise_bars(_vendor(spark, ["360"], D(2025, 1, 2), 1, bump=7.0)), path)
    got = {(r["ticker"], r["trade_date"].day): r["open"] for r in read_raw_csv(spark, path, RAW_BAR_SCHEMA, keys).collect()}
    assert got == {("BHP", 1): 10.0, ("BHP", 2): 11.0, ("360", 1): 10.0, ("360", 2): 17.0}

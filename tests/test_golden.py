"""Toy golden cases for semantics the driver tables do not exercise."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from barlake.functions.columns import business_days_between
from barlake.operators import correlation, curate, normalise, promote, quality, returns
from barlake.sources.files import read_raw_csv, read_ticker_lines, require_rows

D = dt.date


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def _universe(spark, path):
    return [r["ticker"] for r in normalise.ticker_universe(read_ticker_lines(spark, path)).orderBy("pos").collect()]


def test_universe_header_and_headerless(spark, tmp_dir):
    _write(f"{tmp_dir}/a.csv", " Ticker \nBHP\nCBA\n")
    _write(f"{tmp_dir}/b.csv", "BHP\nCBA\n")
    assert _universe(spark, f"{tmp_dir}/a.csv") == ["BHP", "CBA"]
    assert _universe(spark, f"{tmp_dir}/b.csv") == ["BHP", "CBA"]


def test_universe_cleaning_order_and_dedupe(spark, tmp_dir):
    _write(f"{tmp_dir}/t.csv", "ticker\n bhp.ax \n360\nNA\nCBA\n\nCBA\nS32\n")
    assert _universe(spark, f"{tmp_dir}/t.csv") == ["BHPAX", "360", "NA", "CBA", "S32"]


def test_universe_named_column(spark, tmp_dir):
    _write(f"{tmp_dir}/n.csv", "name, Ticker \nBHP Group,bhp\nRio,RIO\n")
    assert _universe(spark, f"{tmp_dir}/n.csv") == ["BHP", "RIO"]


def test_universe_empty_raises(spark, tmp_dir):
    _write(f"{tmp_dir}/e.csv", "ticker\n \n")
    with pytest.raises(RuntimeError):
        require_rows(normalise.ticker_universe(read_ticker_lines(spark, f"{tmp_dir}/e.csv")), "ticker universe")


def test_mixed_11_and_12_column_csv(spark, tmp_dir):
    base = f"{tmp_dir}/raw/tabular/market_ohlcv_daily/exchange=ASX"
    hdr = "dataset_id,exchange,ticker,vendor_symbol,currency,trade_date,open,high,low,close,volume"
    _write(f"{base}/trade_date=2025-11-03/ticker=BHP.csv",
           hdr + "\nmarket_ohlcv_daily,ASX,BHP,BHP.AX,AUD,2025-11-03,43.1,44.0,42.5,43.5,5400000\n")
    _write(f"{base}/trade_date=2025-11-04/ticker=360.csv",
           hdr + ",adj_close\nmarket_ohlcv_daily,ASX,360,360.AX,AUD,2025-11-04,10.0,11.0,9.5,10.5,100,10.25\n")
    rows = {r["ticker"]: r for r in read_raw_csv(spark, f"{tmp_dir}/raw", landed=True).collect()}
    assert rows["BHP"]["adj_close"] is None and rows["BHP"]["volume"] == 5400000 and rows["BHP"]["close"] == 43.5
    assert rows["360"]["adj_close"] == 10.25 and rows["360"]["exchange"] == "ASX"
    assert rows["360"]["trade_date"] == D(2025, 11, 4)


def test_nan_price_becomes_null(spark):
    vendor = spark.createDataFrame(
        [("BHP", "2025-11-03", float("nan"), 2.0, 1.0, 1.5, float("nan"), 10.0)],
        "ticker string, Date string, Open double, High double, Low double, Close double, "
        "`Adj Close` double, Volume double")
    r = normalise.normalise_bars(vendor).collect()[0]
    assert r["open"] is None and r["adj_close"] is None and r["volume"] == 10
    assert r["trade_date"] == D(2025, 11, 3) and r["vendor_symbol"] == "BHP.AX"


def test_missing_date_column_raises(spark):
    with pytest.raises(ValueError):
        normalise.standardise_columns(spark.createDataFrame([(1.0,)], "Open double"))


def _conf_rows(spark, rows):
    return spark.createDataFrame(rows, "dataset_id string, exchange string, ticker string, trade_date date, "
                                       "close double, ingest_ts timestamp, source_object_key string, row_hash string")


def test_latest_wins_valid_ts_beats_unparsable(spark):
    df = _conf_rows(spark, [
        ("d", "ASX", "BHP", D(2025, 1, 2), 1.0, dt.datetime(2025, 1, 2, 1), "k1", "h1"),
        ("d", "ASX", "BHP", D(2025, 1, 2), 2.0, None, "k2", "h2"),
    ])
    assert [r["close"] for r in curate.latest_wins(df).collect()] == [1.0]


def test_latest_wins_tie_break(spark):
    ts = dt.datetime(2025, 1, 2, 1)
    df = _conf_rows(spark, [
        ("d", "ASX", "BHP", D(2025, 1, 2), 1.0, ts, "k1", "h9"),
        ("d", "ASX", "BHP", D(2025, 1, 2), 2.0, ts, "k2", "h1"),
        ("d", "ASX", "BHP", D(2025, 1, 2), 3.0, ts, "k2", "h2"),
    ])
    assert [r["close"] for r in curate.latest_wins(df).collect()] == [3.0]
    # idempotent on duplicated input
    assert curate.latest_wins(df.unionByName(df)).collect() == curate.latest_wins(df).collect()


def test_exact_dedupe_keeps_earliest(spark):
    df = _conf_rows(spark, [
        ("d", "ASX", "BHP", D(2025, 1, 2), 1.0, dt.datetime(2025, 1, 3), "k2", "h"),
        ("d", "ASX", "BHP", D(2025, 1, 2), 1.0, dt.datetime(2025, 1, 2), "k1", "h"),
        ("d", "ASX", "BHP", D(2025, 1, 2), 5.0, dt.datetime(2025, 1, 4), "k3", "g"),
    ])
    got = sorted((r["row_hash"], r["source_object_key"]) for r in curate.exact_dedupe(df).collect())
    assert got == [("g", "k3"), ("h", "k1")]


def _series(spark, values, ticker="T", start=D(2025, 1, 6)):
    return spark.createDataFrame(
        [("SYN", ticker, start + dt.timedelta(days=i), None if v is None else float(v), 100)
         for i, v in enumerate(values)],
        "exchange string, ticker string, trade_date date, adj_close double, volume bigint")


def test_pad_returns(spark):
    r = returns.daily_returns(_series(spark, [1.0, None, 2.0, 0.0, 3.0])).orderBy("trade_date").collect()
    assert [x["ret_1d"] for x in r] == [None, 0.0, 1.0, -1.0, None]
    r = returns.daily_returns(_series(spark, [1.0, None, 2.0]), fill="none").orderBy("trade_date").collect()
    assert [x["ret_1d"] for x in r] == [None, None, None]


def test_constant_and_single_series(spark):
    df = _series(spark, [5.0] * 6, "C").unionByName(_series(spark, [1.0], "ONE"))
    z = returns.return_zscores(returns.daily_returns(df))
    assert all(r["ret_z"] is None for r in z.collect())
    m = correlation.return_matrix(returns.daily_returns(
        df.unionByName(_series(spark, [1.0, 2.0, 1.5, 3.0, 2.0, 2.5], "V"))))
    pairs = {(r["ticker_a"], r["ticker_b"]): r["corr"] for r in correlation.return_correlation(m).collect()}
    assert pairs[("C", "C")] is None or pairs[("C", "C")] != pairs[("C", "C")]
    assert pairs[("C", "V")] is None or pairs[("C", "V")] != pairs[("C", "V")]
    assert pairs[("V", "V")] == pytest.approx(1.0)


def test_log_volume_zero_is_null(spark):
    df = spark.createDataFrame([("SYN", "T", D(2025, 1, 6), v) for v in (0, 100, -5)],
                               "exchange string, ticker string, trade_date date, volume bigint")
    assert sorted((r["volume"], r["log10_volume"]) for r in returns.log_volume(df).collect()) == \
        [(-5, None), (0, None), (100, 2.0)]


def test_business_days_closed_form_vs_bruteforce(spark):
    import random
    rnd = random.Random(1)
    pairs = []
    for _ in range(300):
        s = D(2020, 1, 1) + dt.timedelta(days=rnd.randint(0, 900))
        pairs.append((s, s + dt.timedelta(days=rnd.randint(0, 40))))
    df = spark.createDataFrame(pairs, "s date, e date").select("s", "e", business_days_between("s", "e").alias("b"))
    for r in df.collect():
        want = sum(1 for i in range((r["e"] - r["s"]).days + 1) if (r["s"] + dt.timedelta(days=i)).weekday() < 5)
        assert r["b"] == want


def test_saturday_bars_make_missing_negative(spark):
    # Mon..Sun of one week: 7 rows, 5 business days
    df = _series(spark, [1.0] * 7, start=D(2025, 1, 6))
    r = quality.ticker_coverage(df).collect()[0]
    assert r["expected_bdays"] == 5 and r["missing_bdays"] == -2
    assert quality.missing_business_days(df).count() == 0


def test_first_date_not_in_80pct_base(spark):
    # 3 tickers, 6 dates: first date never has a return, so the base is 5 dates -> min_obs 4
    df = _series(spark, [1, 2, 3, 4, 5, 6], "A").unionByName(_series(spark, [1, 2, 1, 2, 1, 2], "B")) \
        .unionByName(_series(spark, [1, None, None, 2, 3, 4], "C"))
    m = correlation.return_matrix(returns.daily_returns(df, fill="none"))
    got = {r["ticker"]: (r["n_obs"], r["min_obs"]) for r in correlation.tickers_min_obs(m).collect()}
    assert got == {"A": (5, 4), "B": (5, 4)}


def test_promotion_modes(spark):
    rows = spark.createDataFrame([("k1", "h1"), ("k2", "h2")], "source_object_key string, row_hash string")
    existing = spark.createDataFrame([("k1", "h1"), ("k2", "hOLD")], "source_object_key string, row_hash string")
    assert promote.promote(rows, existing, "by_key").count() == 0
    assert [r["source_object_key"] for r in promote.promote(rows, existing, "by_content").collect()] == ["k2"]


def test_row_hash_null_and_missing_fields(spark):
    df = spark.createDataFrame([("d", "ASX", "BHP", D(2025, 1, 2), None, 1.0)],
                               "dataset_id string, exchange string, ticker string, trade_date date, "
                               "open double, high double")
    import hashlib
    want = hashlib.sha256(b"d|ASX|BHP|2025-01-02|nan|0x1.0p0||||").hexdigest()
    assert promote.add_row_hash(df).collect()[0]["row_hash"] == want


def test_empty_inputs_keep_schema(spark):
    empty = spark.createDataFrame([], "dataset_id string, exchange string, ticker string, trade_date date, "
                                      "open double, high double, low double, close double, volume bigint, "
                                      "adj_close double")
    for df in (quality.ticker_coverage(empty), quality.ohlc_violations(empty),
               returns.daily_returns(empty), quality.duplicate_rows(empty)):
        assert df.count() == 0 and len(df.columns) > 0
    assert quality.null_rates(empty).count() == 10


def test_quarantine_split(spark, tmp_dir):
    from barlake.sources.files import read_raw_csv_quarantine
    hdr = "dataset_id,exchange,ticker,vendor_symbol,currency,trade_date,open,high,low,close,volume,adj_close"
    _write(f"{tmp_dir}/q/exchange=ASX/trade_date=2025-11-03/ticker=BHP.csv",
           hdr + "\nmarket_ohlcv_daily,ASX,BHP,BHP.AX,AUD,2025-11-03,1.0,2.0,0.5,1.5,10,1.4\n")
    _write(f"{tmp_dir}/q/exchange=ASX/trade_date=2025-11-03/ticker=BAD.csv",
           hdr + "\nmarket_ohlcv_daily,ASX,BAD,BAD.AX,AUD,2025-11-03,abc,2.0,0.5,1.5,10,1.4\n")
    good, bad = read_raw_csv_quarantine(spark, f"{tmp_dir}/q")
    assert [r["ticker"] for r in good.collect()] == ["BHP"]
    bad_rows = bad.collect()
    assert len(bad_rows) == 1 and "abc" in bad_rows[0]["unparsed_record"]


def test_retention_and_universe_snapshot(spark):
    from barlake.operators import control
    keys = spark.createDataFrame([("heartbeat/airflow_time_20240101_101500.txt",),
                                  ("heartbeat/airflow_time_20240129_101500.txt",), ("heartbeat/other.txt",)], "key string")
    old = [r["key"] for r in control.retention_candidates(keys, "2024-01-30", 7).collect()]
    assert old == ["heartbeat/airflow_time_20240101_101500.txt"]
    u = spark.createDataFrame([("BHP", 0)], "ticker string, pos long")
    assert control.universe_snapshot(u, "2025-01-01").collect()[0]["constituents_snapshot_date"] == D(2025, 1, 1)


def test_newest_heartbeat_object(spark, tmp_dir):
    import time
    from barlake.operators.curate import newest_object
    from barlake.sources.files import read_text_objects
    _write(f"{tmp_dir}/hb/heartbeat/airflow_time_20240101_000000.txt", "2024-01-01 11:00:00 AEDT\n")
    time.sleep(1.1)
    _write(f"{tmp_dir}/hb/heartbeat/airflow_time_20240101_000100.txt", "2024-01-01 11:01:00 AEDT\n")
    top = newest_object(read_text_objects(spark, f"{tmp_dir}/hb")).collect()
    assert len(top) == 1 and top[0]["value"] == "2024-01-01 11:01:00 AEDT"


def test_exact_text_tells_doubles_apart(spark):
    """Equal text only for equal doubles: tiny, huge, neighbouring and negative values, powers of two."""
    import math
    from barlake.functions.columns import exact_double_text
    values = [0.0, 1e-7, 4e-7, 1e13, 5e14, 1.0, 2.0, 0.5, 1 / 3, -1 / 3, math.pi, 1e308, 5e-324, 2.2250738585072014e-308, 0.1, 1023.9999999999999, 1024.0]
    values += [math.nextafter(v, math.inf) for v in values] + [math.nextafter(v, -math.inf) for v in values[2:12]]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", exact_double_text("x").alias("t")).collect()
    assert len({r["t"] for r in rows}) == len(set(values))
    for r in rows:                                                                   # another implementation's digits, and its reading of these
        m, _, e = r["x"].hex().partition("p")
        digits = m.rstrip("0") + ("0" if m.rstrip("0").endswith(".") else "")
        assert r["t"] == ("0" if r["x"] == 0 else f"{digits}p{int(e)}") and float.fromhex(r["t"]) == r["x"]
    odd = spark.createDataFrame([(None,), (float("nan"),), (-0.0,), (float("-inf"),)], "x double").select(exact_double_text("x").alias("t")).collect()
    assert [r["t"] for r in odd] == [None, None, "0", "-inf"]


def test_zone_abbreviation_follows_the_zone(spark):
    import datetime as dt
    from barlake.functions.columns import local_tz_abbreviation
    rows = [(dt.datetime(2024, 1, 15),), (dt.datetime(2024, 7, 15),)]
    df = spark.createDataFrame(rows, "ts timestamp")
    new_york = {"daylight": "EDT", "standard": "EST"}
    got = df.select(local_tz_abbreviation("ts").alias("m"), local_tz_abbreviation("ts", "America/New_York", new_york).alias("n")).collect()
    assert [tuple(r) for r in got] == [("AEDT", "EST"), ("AEST", "EDT")]


def test_typed_bars_raises_on_bad_text(spark):
    from barlake.operators.normalise import typed_bars
    good = spark.createDataFrame([("BHP", "2025-01-02", "1.5", "7")], "ticker string, trade_date string, open string, volume string")
    assert typed_bars(good).collect()[0].asDict() == {"ticker": "BHP", "trade_date": D(2025, 1, 2), "open": 1.5, "volume": 7}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        typed_bars(good.withColumn("open", F.lit("abc"))).collect()


def test_listing_must_not_be_empty(spark):
    from barlake.sources.files import require_objects
    with pytest.raises(RuntimeError):
        require_objects(spark.createDataFrame([], "key string"), "listing")

"""Mergeable sketches, wide export, dated membership, datasets by spec, raw layouts and the report set."""
import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake.operators import quality
from barlake.operators.membership import SNAPSHOT_DATE, membership_intervals, read_universe, write_universe
from barlake.operators.sketches import DISTINCT_ERROR, RANK_ERROR, daily_sketches, merged_profile
from barlake.operators.wide import export_wide, matrix_shape, read_block, read_long, read_manifest
from barlake.plans import lake_jobs, reports
from barlake.sources.files import read_raw_csv, read_zone, write_raw_csv
from barlake.spec import DATASETS, RAW_BAR_SCHEMA, DatasetSpec, LakePaths

D = dt.date


# --- sketches ---------------------------------------------------------------------

def test_merged_sketches_keep_their_error(spark, tmp_dir):
    rng = np.random.default_rng(3)
    n = 60_000
    day = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 12, n))                 # a third of the rows on one day
    x = np.exp(rng.normal(0, 2, n))
    who = rng.integers(0, 20_000, n)
    rows = spark.createDataFrame([(D(2025, 1, 1 + int(d)), int(w), float(v) if i % 50 else None) for i, (d, w, v) in enumerate(zip(day, who, x))], "day date, who long, x double")
    daily_sketches(rows.repartition(6), "day", ["who"], ["x"]).write.parquet(f"{tmp_dir}/sketches")
    stored = spark.read.parquet(f"{tmp_dir}/sketches")
    assert stored.count() == 12
    for first, last in ((0, 11), (0, 0), (3, 7)):
        of = (day >= first) & (day <= last)
        got = merged_profile(stored.where(F.col("day").between(D(2025, 1, 1 + first), D(2025, 1, 1 + last))), [], ["who"], ["x"], (0.05, 0.5, 0.99)).first()
        values = np.sort(x[of & (np.arange(n) % 50 != 0)])
        distinct = len(set(who[of].tolist()))
        assert got["rows"] == of.sum() and got["x_count"] == len(values) and (got["x_min"], got["x_max"]) == (values[0], values[-1])
        assert abs(got["who_estimate"] - distinct) <= DISTINCT_ERROR * distinct
        for q in (5, 50, 99):
            assert abs(np.searchsorted(values, got[f"x_p{q:02d}"]) / len(values) - q / 100) <= RANK_ERROR


def test_sketch_of_a_day_without_values(spark):
    rows = spark.createDataFrame([(D(2025, 1, 1), 1, None), (D(2025, 1, 2), None, 2.0)], "day date, who long, x double")
    sketches = daily_sketches(rows, "day", ["who"], ["x"])
    got = {r["day"]: r for r in merged_profile(sketches, [F.col("day")], ["who"], ["x"], (0.5,)).collect()}
    assert got[D(2025, 1, 1)]["x_p50"] is None and got[D(2025, 1, 2)]["x_p50"] == 2.0 and got[D(2025, 1, 2)]["who_estimate"] == 0


# --- wide export --------------------------------------------------------------------

def test_wide_blocks_hold_the_long_matrix(spark, tmp_dir):
    rows = [(D(2025, 1, 1 + d), f"T{t:02d}.A`X", float(100 * t + d)) for t in range(23) for d in range(6) if (t + d) % 4]
    matrix = spark.createDataFrame(rows, "trade_date date, ticker string, ret_1d double")
    shape = matrix_shape(export_wide(matrix, f"{tmp_dir}/wide", block_columns=5)).first()
    assert tuple(shape) == (6, 23)
    entries = read_manifest(spark, f"{tmp_dir}/wide").orderBy("block").collect()
    assert [e["columns"] for e in entries] == [5, 5, 5, 5, 3]
    names = [c for e in entries for c in read_block(spark, f"{tmp_dir}/wide", e).columns[1:]]
    assert names == sorted({r[1] for r in rows}) and all(read_block(spark, f"{tmp_dir}/wide", e).count() == 6 for e in entries)
    assert sorted(map(tuple, read_long(spark, f"{tmp_dir}/wide").collect())) == sorted(rows)


def test_wide_export_of_an_empty_matrix(spark, tmp_dir):
    none = spark.createDataFrame([], "trade_date date, ticker string, ret_1d double")
    assert tuple(matrix_shape(export_wide(none, f"{tmp_dir}/wide")).first()) == (0, 0)
    assert read_long(spark, f"{tmp_dir}/wide").collect() == []


def test_wide_export_takes_as_many_jobs_for_many_blocks(spark, tmp_dir):
    """The number of Spark jobs doesn't grow with the blocks, nor the scans of the way back; null names and days are kept."""
    names = [None, 'a"b\\', "A", "a", "trade_date", *[f"t{i:02d}" for i in range(35)]]
    rows = [(D(2025, 1, 1 + d) if d else None, t, float(10 * i + d)) for i, t in enumerate(names) for d in range(4) if (i + d) % 3]
    matrix = spark.createDataFrame(rows, "trade_date date, ticker string, ret_1d double")
    scans = {}
    for block_columns in (40, 1):
        path = f"{tmp_dir}/wide-{block_columns}"
        shape = matrix_shape(export_wide(matrix, path, block_columns=block_columns)).first()
        back = read_long(spark, path)
        scans[block_columns] = back._jdf.queryExecution().executedPlan().toString().count("Scan parquet")
        assert tuple(shape) == (3, 39) and sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, rows))
        assert [e["columns"] for e in read_manifest(spark, path).orderBy("block").collect()] == ([39] if block_columns == 40 else [0] + [1] * 39)
    assert scans == {40: 1, 1: 1}


# --- duplicates -----------------------------------------------------------------------

def test_one_row_of_each_duplicated_key_is_first(spark):
    rows = [("A", "HOT", D(2025, 1, 1), i % 7, "same") for i in range(3000)] + [("A", f"T{i % 900}", D(2025, 1, 2), i, "x") for i in range(6000)]
    rows += [("A", None, D(2025, 1, 1), 1, "n"), ("A", None, D(2025, 1, 1), 0, "n"), ("A", "once", D(2025, 1, 1), 0, "")]
    df = spark.createDataFrame(rows, "exchange string, ticker string, trade_date date, n int, note string").repartition(5)
    got = quality.duplicate_rows(df).collect()
    assert len(got) == 9002 and {r["key_rows"] for r in got if r["ticker"] == "HOT"} == {3000}
    first = [r for r in got if r["first_kept"]]
    assert len(first) == 902 and all(r["n"] == (int(r["ticker"][1:]) if r["ticker"] and r["ticker"] != "HOT" else 0) for r in first)
    late = [r for r in quality.duplicate_rows(df, order=("note",)).collect() if r["first_kept"]]
    assert len(late) == 902                                                          # ties of the order: still one of each key


# --- dated universe -------------------------------------------------------------------

def test_membership_from_snapshots(spark, tmp_dir):
    path, days = f"{tmp_dir}/universe", [D(2025, m, 1) for m in (1, 2, 3, 4)]
    with pytest.raises(RuntimeError):
        read_universe(spark, path)
    for day, tickers in zip(days, (["A", "B"], ["A", "C"], ["C", "B"], ["C", "A", "B"])):
        write_universe(spark.createDataFrame([(t, i) for i, t in enumerate(tickers)], "ticker string, pos long"), path, day)
    write_universe(spark.createDataFrame([("A", 0), ("C", 1)], "ticker string, pos long"), path, days[1])      # written again: replaced
    got = sorted(map(tuple, membership_intervals(read_universe(spark, path)).collect()), key=str)
    assert got == sorted([("A", days[0], days[2]), ("A", days[3], None), ("B", days[0], days[1]), ("B", days[2], None), ("C", days[1], None)], key=str)
    assert {r["ticker"] for r in read_universe(spark, path, "2025-03-20").collect()} == {"B", "C"}
    assert read_universe(spark, path, "2024-12-31").collect() == []
    assert read_universe(spark, path).select(SNAPSHOT_DATE).distinct().count() == 4


# --- datasets by spec --------------------------------------------------------------------

def test_a_dataset_of_its_own_keys(spark, tmp_dir):
    from pyspark.sql import types as T
    spec = DatasetSpec(dataset_id="readings", business_key=("dataset_id", "site", "day", "sensor", "slot"), analysis_key=("site", "day", "sensor", "slot"),
                       series_key=("site", "sensor"), date_column="day", partition_columns=("site", "day"), hash_fields=("dataset_id", "sensor", "slot", "value"),
                       raw_schema=T.StructType([T.StructField("dataset_id", T.StringType()), T.StructField("site", T.StringType()), T.StructField("day", T.DateType()),
                                                T.StructField("sensor", T.StringType()), T.StructField("slot", T.IntegerType()), T.StructField("value", T.DoubleType())]))
    paths = LakePaths.under(tmp_dir)
    rows = [("readings", "s1", D(2025, 1, 1), "a", 1, 1.5), ("readings", "s1", D(2025, 1, 1), "a", 2, 2.5), ("readings", "s2", D(2025, 1, 2), "b", 1, None)]

    def deliver(rows, day):
        write_raw_csv(spark.createDataFrame(rows, spec.raw_schema), paths.table("raw", spec), spec.partition_columns)
        new = lake_jobs.promote_raw(spark, paths, dt.datetime(2025, 2, day), f"b{day}", "by_content", spec).count()
        return new, lake_jobs.refresh_snapshots(spark, paths, spec=spec)

    assert deliver(rows, 1) == (3, [("s1", D(2025, 1, 1)), ("s2", D(2025, 1, 2))])
    assert deliver([(*rows[1][:5], 9.0), rows[2]], 2) == (1, [("s1", D(2025, 1, 1))])
    got = read_zone(spark, paths.table("curated", spec), spec.conformed_schema).collect()
    assert sorted((r["site"], r["slot"], r["value"], r["ingest_batch_id"]) for r in got if r["value"]) == [("s1", 1, 1.5, "b1"), ("s1", 2, 9.0, "b2")]
    assert "tabular/readings/site=s2/day=2025-01-02/sensor=b/slot=1.csv" in {r["source_object_key"] for r in got}
    assert set(DATASETS) == {"market_ohlcv_daily", "user_events"}


# --- raw layouts ---------------------------------------------------------------------------

def test_a_raw_record_that_does_not_parse_raises(spark, tmp_dir):
    bars = spark.createDataFrame([("d", "ASX", "BHP", "BHP.AX", "AUD", D(2025, 1, 2), 1.0, 1.0, 1.0, 1.0, 10, None)], RAW_BAR_SCHEMA)
    write_raw_csv(bars, f"{tmp_dir}/raw")
    assert read_raw_csv(spark, f"{tmp_dir}/raw").count() == 1
    with open(f"{tmp_dir}/raw/exchange=ASX/trade_date=2025-01-02/landed.csv", "w") as f:
        f.write("dataset_id,ticker,vendor_symbol,currency,open,high,low,close,volume\nd,BAD,BAD.AX,AUD,abc,2,1,1,10\n")
    with pytest.raises(Exception, match=r"raw record does not parse \(open\)"):
        read_raw_csv(spark, f"{tmp_dir}/raw").collect()


def test_quoted_fields_of_a_ticker_list(spark, tmp_dir):
    from barlake.operators.normalise import ticker_universe
    from barlake.sources.files import read_ticker_lines
    os.makedirs(f"{tmp_dir}/list")
    with open(f"{tmp_dir}/list/tickers.csv", "w") as f:
        f.write('name," Ticker "\n"Big, ""Old"" Co",bhp.ax\nPlain,"c b a"\n"a,b,c", 360 \n')
    got = ticker_universe(read_ticker_lines(spark, f"{tmp_dir}/list")).orderBy("pos").collect()
    assert [r["ticker"] for r in got][:1] == ["BHPAX"] and {r["ticker"] for r in got} == {"BHPAX", "CBA", "360"}


# --- report set -----------------------------------------------------------------------------

def test_report_set_round_trip(spark, tmp_dir):
    when = dt.datetime(2025, 1, 1, 1, 2, 3, 456789)
    small = spark.createDataFrame([(3, "c", when), (1, None, None), (2, "a,\"b", when)], "n int, s string, t timestamp").orderBy("n")
    large = spark.range(1000).select("id", (F.col("id") / 7).alias("x"))
    reports.write_reports(tmp_dir, {"small": small, "large": large}, small=("small",))
    back = reports.read_reports(spark, tmp_dir)
    assert [tuple(r) for r in back["small"].collect()] == [(1, None, None), (2, "a,\"b", when), (3, "c", when)]
    assert sorted(map(tuple, back["large"].collect())) == sorted(map(tuple, large.collect()))
    manifest = [json.loads(line) for f in os.listdir(f"{tmp_dir}/manifest") if f.startswith("part") for line in open(f"{tmp_dir}/manifest/{f}")]
    assert {m["name"]: m["rows"] for m in manifest} == {"small": 3, "large": 1000}
    small.limit(1).write.mode("append").option("header", True).option("timestampFormat", reports.CSV_TIMESTAMPS).csv(f"{tmp_dir}/small")
    with pytest.raises(RuntimeError, match="small has 4 rows"):
        reports.read_reports(spark, tmp_dir)

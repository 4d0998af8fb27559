"""Listings, versioned promotion, replayed batches, the state log, object overwrite and global positions."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from barlake.operators import control, promote
from barlake.operators.positions import with_positions
from barlake.plans import lake_jobs
from barlake.sources.files import list_objects, read_zone, write_raw_csv
from barlake.sources.listing import footprint, list_partitions, object_folder, partition_value, write_text_objects
from barlake.spec import CONFORMED_SCHEMA, RAW_BAR_SCHEMA, LakePaths
from barlake.streaming import jobs
from barlake.streaming.commits import read_batches, stream_id, write_batch

D = dt.date


def _bars(spark, rows):
    return spark.createDataFrame([("market_ohlcv_daily", "ASX", t, t + ".AX", "AUD", d, c, c, c, c, 10, c) for t, d, c in rows], RAW_BAR_SCHEMA)


def _forget_last_commit(checkpoint):
    """As if the last batch had broken off between its writes and its commit."""
    commits = sorted((int(x) for x in os.listdir(f"{checkpoint}/commits") if x.isdigit()))
    for name in (f"{commits[-1]}", f".{commits[-1]}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")


# --- listings ---------------------------------------------------------------------

def test_partition_values_come_from_paths(spark):
    rows = [("file:/z/exchange=A%2FB+C/trade_date=2024-02-29/p.csv",), ("/z/exchange=__HIVE_DEFAULT_PARTITION__/trade_date=soon/p.csv",), ("trade_date=2024-01-01/p.csv",), ("/z/x.csv",)]
    got = spark.createDataFrame(rows, "path string").select(partition_value(F.col("path"), "exchange").alias("e"), partition_value(F.col("path"), "trade_date", "date").alias("d"))
    assert [tuple(r) for r in got.collect()] == [("A/B+C", D(2024, 2, 29)), (None, None), (None, D(2024, 1, 1)), (None, None)]


def test_listing_of_text_objects(spark, tmp_dir):
    lines = spark.createDataFrame([(D(2024, 1, 1), "a b", 2, "second"), (D(2024, 1, 1), "a b", 1, "first"), (D(2024, 1, 2), "c", 1, None)], "trade_date date, part string, n int, value string")
    write_text_objects(lines, f"{tmp_dir}/z", ["trade_date", "part"], ["n"])
    listing = list_partitions(spark, f"{tmp_dir}/z", {"trade_date": "date", "part": "string"}, glob="*.txt")
    got = {(r["trade_date"], r["part"]): r["length"] for r in listing.collect()}
    assert got == {(D(2024, 1, 1), "a b"): 13, (D(2024, 1, 2), "c"): 1}
    assert {r["k"] for r in listing.select(object_folder(F.col("key")).alias("k")).collect()} == {"trade_date=2024-01-01/part=a b", "trade_date=2024-01-02/part=c"}
    assert [tuple(r) for r in footprint(listing, ["trade_date"]).orderBy("trade_date").collect()] == [(D(2024, 1, 1), 1, 13, 13, 13.0), (D(2024, 1, 2), 1, 1, 1, 1.0)]
    assert spark.read.text(f"{tmp_dir}/z/trade_date=2024-01-01").collect()[0]["value"] == "first"
    assert list_partitions(spark, f"{tmp_dir}/none", {"trade_date": "date"}).collect() == []


# --- versioned promotion -------------------------------------------------------------

@pytest.mark.parametrize("mode,want", [("by_content", [1.0, 2.0, 1.0]), ("by_key", [1.0])])
def test_restatement_back_to_an_earlier_value(spark, tmp_dir, mode, want):
    paths, day = LakePaths.under(tmp_dir), D(2025, 1, 2)
    for n, price in enumerate((1.0, 2.0, 1.0, 1.0)):                                 # the last delivery brings nothing new
        write_raw_csv(_bars(spark, [("BHP", day, price)]), paths.table("raw"))
        lake_jobs.promote_raw(spark, paths, dt.datetime(2025, 1, 3 + n), f"b{n}", mode)
        lake_jobs.refresh_snapshots(spark, paths)
    stored = read_zone(spark, paths.table("conformed"), CONFORMED_SCHEMA).orderBy("ingest_ts").collect()
    assert [r["close"] for r in stored] == want
    assert [r["close"] for r in read_zone(spark, paths.table("curated"), CONFORMED_SCHEMA).collect()] == [want[-1]]


@pytest.mark.parametrize("mode", ["by_content", "by_key"])
def test_promotion_moves_rows_once_and_hashes_new_objects_only(spark, tmp_dir, monkeypatch, mode):
    paths, day, plans, write = LakePaths.under(tmp_dir), D(2025, 1, 2), [], jobs.stored

    def planned(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(jobs, "stored", planned)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for n, prices in enumerate(([("BHP", 1.0), ("CBA", 5.0)], [("BHP", 2.0), ("CBA", 5.0), ("CSL", 7.0)])):
            write_raw_csv(_bars(spark, [(t, day, p) for t, p in prices]), paths.table("raw"))
            lake_jobs.promote_raw(spark, paths, dt.datetime(2025, 1, 3 + n), f"b{n}", mode)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    plan = plans[-1]
    assert plan.count("Exchange hashpartitioning") == 2                               # the rows and the zone, each once
    if mode == "by_key":
        assert plan.rindex("sha2(") < plan.index("SortMergeJoin")                    # above the join
    got = {(r["ticker"], r["close"], r["ingest_batch_id"]) for r in read_zone(spark, paths.table("conformed"), CONFORMED_SCHEMA).collect()}
    restated = {("BHP", 2.0, "b1")} if mode == "by_content" else set()
    assert got == {("BHP", 1.0, "b0"), ("CBA", 5.0, "b0"), ("CSL", 7.0, "b1")} | restated


def test_unknown_mode_raises(spark):
    rows = spark.createDataFrame([], CONFORMED_SCHEMA)
    with pytest.raises(ValueError):
        promote.promote(rows, rows, "by_magic")


# --- replayed batches ---------------------------------------------------------------

def test_replayed_batch_quarantines_and_promotes_once(spark, tmp_dir):
    paths = LakePaths.under(tmp_dir)
    raw, conformed = paths.table("raw"), paths.table("conformed")
    write_raw_csv(_bars(spark, [("BHP", D(2025, 1, 2), 1.0)]), raw)
    with open(f"{raw}/exchange=ASX/trade_date=2025-01-02/landed.csv", "w") as f:
        f.write("dataset_id,ticker,vendor_symbol,currency,open,high,low,close,volume\nmarket_ohlcv_daily,BAD,BAD.AX,AUD,abc,2,1,1,10\n")
    lake_jobs.promote_raw(spark, paths, dt.datetime(2025, 1, 3), "b1")
    _forget_last_commit(f"{conformed}_checkpoint")
    lake_jobs.promote_raw(spark, paths, dt.datetime(2025, 1, 4), "b1")
    bad = spark.read.json(f"{conformed}_quarantine").collect()
    assert len(bad) == 1 and bad[0]["stream"] == stream_id(spark, f"{conformed}_checkpoint")
    assert read_zone(spark, conformed, CONFORMED_SCHEMA).count() == 1


def test_replayed_batch_copies_objects_once(spark, tmp_dir):
    src, sink, log = f"{tmp_dir}/src", f"{tmp_dir}/sink", f"{tmp_dir}/_log"
    for k in ("heartbeat/airflow_time_20240101_000000.txt", "heartbeat/airflow_time_20240102_000000.txt", "notes/a.txt"):
        os.makedirs(os.path.dirname(f"{src}/{k}"), exist_ok=True)
        with open(f"{src}/{k}", "w") as f:
            f.write(k)
    jobs.copy_objects(spark, src, sink, log)
    _forget_last_commit(log)
    jobs.copy_objects(spark, src, sink, log)
    jobs.copy_objects(spark, src, sink, f"{tmp_dir}/_other_log")
    got = spark.read.parquet(sink).collect()
    assert sorted(bytes(r["content"]).decode() for r in got) == sorted(r["key"] for r in got) and len(got) == 3
    assert {r["part"] for r in got} == {"20240101", "20240102", "notes"}


def test_newest_of_equal_keys_and_only_touched_parts(spark, tmp_dir):
    schema = "key string, modified timestamp, content string"
    sink, t = f"{tmp_dir}/sink", dt.datetime(2025, 1, 1)
    first = [("a/x", t, "old"), ("a/x", t + dt.timedelta(hours=1), "new"), ("b/y", t, "b")]
    assert promote.copy_new_objects(spark.createDataFrame(first, schema), sink, batch=0).count() == 2
    os.makedirs(f"{sink}/stream=copy/batch=0/part=b", exist_ok=True)
    with open(f"{sink}/stream=copy/batch=0/part=b/broken.parquet", "w") as f:                 # reading that part would fail
        f.write("not parquet")
    copied = promote.copy_new_objects(spark.createDataFrame([("a/x", t, "again"), ("a/z", t, "z")], schema), sink, batch=1)
    assert [tuple(r)[0] for r in copied.collect()] == ["a/z"]
    assert {r["content"] for r in spark.read.parquet(f"{sink}/stream=copy/batch=0/part=a").collect()} == {"new"}


def test_a_batch_replaces_only_its_own_folder(spark, tmp_dir):
    schema = spark.range(1).schema
    assert read_batches(spark, f"{tmp_dir}/sink", schema).collect() == []
    write_batch(spark.range(3), f"{tmp_dir}/sink", "s", 0)
    write_batch(spark.range(2), f"{tmp_dir}/sink", "s", 1)
    write_batch(spark.range(5, 9), f"{tmp_dir}/sink", "s", 1)                        # fails before, other rows now
    got = read_batches(spark, f"{tmp_dir}/sink", schema).collect()
    assert sorted(tuple(r) for r in got) == [(0, "s", 0), (1, "s", 0), (2, "s", 0), (5, "s", 1), (6, "s", 1), (7, "s", 1), (8, "s", 1)]


# --- state log ------------------------------------------------------------------------

def _state(spark, rows, day):
    ts = dt.datetime(2025, 1, day)
    outcome = [(t, s, 1 if s == "complete" else None, ts if s == "complete" else None, None if s == "complete" else "e", None if s == "complete" else ts) for t, s in rows]
    df = spark.createDataFrame(outcome, "ticker string, status string, rows_written long, completed_at timestamp, error string, failed_at timestamp")
    return control.state_rows(df, "2025-01-01", ts)


def test_state_log_is_compacted(spark, tmp_dir):
    path = f"{tmp_dir}/state"
    assert control.load_state(spark, path) is None and control.compact_state(spark, path) is None and control.expire_state(spark, path) == 0
    control.append_state(_state(spark, [("A", "error"), ("B", "complete")], 1), path)
    control.append_state(_state(spark, [("A", "error"), ("C", "error")], 2), path)
    before = {tuple(r) for r in control.load_state(spark, path).collect()}
    mark = control.compact_state(spark, path)
    assert mark == "20250102T000000000000" and control.compact_state(spark, path) == mark
    assert {tuple(r) for r in control.load_state(spark, path).collect()} == before
    assert control.expire_state(spark, path) == 2
    assert {tuple(r) for r in control.load_state(spark, path).collect()} == before and list_objects(spark, path, glob="*.json").count() == 0
    control.append_state(_state(spark, [("A", "complete")], 3), path)
    control.append_state(_state(spark, [("A", "complete")], 3), path)                # a run repeated with its time
    assert spark.read.json(path).count() == 1
    assert {r["ticker"]: (r["status"], r["last_updated"].day) for r in control.load_state(spark, path).collect()} == {"A": ("complete", 3), "B": ("complete", 1), "C": ("error", 2)}
    control.compact_state(spark, path)
    assert control.expire_state(spark, path) == 2                                    # the run and the snapshot before
    assert control.load_state(spark, path).count() == 3


def test_a_compaction_that_breaks_off_changes_nothing(spark, tmp_dir):
    path = f"{tmp_dir}/state"
    control.append_state(_state(spark, [("A", "error")], 1), path)
    spark.createDataFrame([], control._state_schema()).write.parquet(f"{path}_snapshots/through=20250101T000000000000")   # no mark: not finished
    assert [r["ticker"] for r in control.load_state(spark, path).collect()] == ["A"]
    assert control.compact_state(spark, path) == "20250101T000000000000" and control.load_state(spark, path).count() == 1


def test_later_runs_only_are_read_with_a_snapshot(spark, tmp_dir):
    path = f"{tmp_dir}/state"
    control.append_state(_state(spark, [("A", "error")], 1), path)
    control.compact_state(spark, path)
    for f in os.listdir(f"{path}/run=20250101T000000000000"):
        if f.endswith(".json"):
            with open(f"{path}/run=20250101T000000000000/{f}", "w") as out:
                out.write("{not json\n")                                             # would raise if it were read
            os.remove(f"{path}/run=20250101T000000000000/.{f}.crc")
    assert control.load_state(spark, path).count() == 1


def test_state_documents_of_bounded_size(spark, tmp_dir):
    rows = [(f"T{i}", "complete") for i in range(25)]
    state = _state(spark, rows, 1).select("ticker", "status", "rows_written", "completed_at", "error", "failed_at")
    control.write_state_docs(state, f"{tmp_dir}/docs", "2025-01-01", dt.datetime(2025, 1, 1), tickers_per_doc=10)
    docs = control.read_state_doc(spark, f"{tmp_dir}/docs")
    assert 1 < docs.count() <= 3 and {r["version"] for r in docs.collect()} == {1}
    assert sorted(tuple(r) for r in control.state_doc_table(docs).collect()) == sorted(tuple(r) for r in state.collect())


# --- positions ---------------------------------------------------------------------------

def test_positions_over_several_tasks(spark):
    rows = spark.range(0, 5000, numPartitions=7).select(((F.col("id") * 7919) % 5000).alias("v"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = with_positions(rows, [F.desc("v")]).select("*", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(r["position"] for r in got) == list(range(1, 5001)) and all(r["position"] == 5000 - r["v"] for r in got)
    assert len({r["p"] for r in got}) > 1
    by_group = [r["position"] for r in sorted(with_positions(rows, ["k", "v"]).collect(), key=lambda r: (r["k"], r["v"]))]      # a key with a third of the rows
    assert by_group == list(range(1, 5001))
    assert with_positions(rows.where("v < 0"), ["v"]).collect() == []

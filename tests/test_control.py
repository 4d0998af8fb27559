"""Resumable backfill: state round trip, retry of errors, append-only audit, report sink."""
import datetime as dt
import os


from barlake.operators import control, curate
from barlake.plans import reports
from barlake.plans.frames import faulted

D = dt.date
RUN1, RUN2 = dt.datetime(2025, 1, 1, 1), dt.datetime(2025, 1, 2, 1)


def test_resume_skips_complete_and_retries_errors(spark, tmp_dir):
    universe = spark.createDataFrame([("BHP", 0), ("CBA", 1), ("XYZ", 2)], "ticker string, pos long")
    fetched1 = spark.createDataFrame([("BHP", D(2025, 1, 1)), ("CBA", D(2024, 12, 31))], "ticker string, trade_date date")
    state_path, audit_path = f"{tmp_dir}/state", f"{tmp_dir}/audit"
    assert control.load_state(spark, state_path) is None
    out1 = control.run_backfill(universe, fetched1, "2025-01-01", RUN1)
    control.append_state(control.state_rows(out1, "2025-01-01", RUN1), state_path)
    control.append_audit(control.audit_errors(out1, "2025-01-01", RUN1), audit_path)
    prev = control.load_state(spark, state_path)
    pending = sorted(r["ticker"] for r in control.pending_tickers(universe, prev).collect())
    assert pending == ["XYZ"]
    fetched2 = spark.createDataFrame([("XYZ", D(2025, 1, 2))], "ticker string, trade_date date")
    out2 = control.run_backfill(universe.join(control.pending_tickers(universe, prev), "ticker", "left_semi"),
                                fetched2, "2025-01-02", RUN2)
    merged = control.merge_state(prev.select(*out2.columns), out2)
    assert {r["ticker"]: r["status"] for r in merged.collect()} == {"BHP": "complete", "CBA": "complete",
                                                                     "XYZ": "complete"}
    control.append_audit(control.audit_errors(out2, "2025-01-02", RUN2), audit_path)
    audit = spark.read.json(audit_path)
    assert [r["ticker"] for r in audit.collect()] == ["XYZ"]


def test_corrupt_state_raises(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/bad")
    with open(f"{tmp_dir}/bad/part-0.json", "w") as f:
        f.write('{"ticker": "BHP", "rows_written": "many"}\n{not json\n')
    import pytest
    with pytest.raises(Exception):
        control.load_state(spark, f"{tmp_dir}/bad").collect()


def test_text_ingest_ts_is_coerced(spark):
    df = spark.createDataFrame([("d", "ASX", "BHP", D(2025, 1, 2), "2025-01-02T01:00:00Z", "k1", "h1"),
                                ("d", "ASX", "BHP", D(2025, 1, 2), "garbage", "k2", "h2")],
                               "dataset_id string, exchange string, ticker string, trade_date date, "
                               "ingest_ts string, source_object_key string, row_hash string")
    got = curate.latest_wins(df).collect()
    assert [r["source_object_key"] for r in got] == ["k1"]


def test_report_sink(spark, sf_dir, tmp_dir):
    bars = faulted(spark, sf_dir)
    summary = reports.eda_summary(bars)
    reports.write_reports(tmp_dir, {"eda_metrics": summary.drop("summary")}, small=("eda_metrics",))
    reports.write_summary_text(summary, tmp_dir)
    text = open([os.path.join(f"{tmp_dir}/eda_summary", f) for f in os.listdir(f"{tmp_dir}/eda_summary")
                 if f.startswith("part-")][0]).read()
    assert text.startswith("Rows: ") and text.count("\n") >= 8


def test_heartbeat_stream(spark, tmp_dir):
    import time
    from barlake.streaming import jobs
    q = jobs.heartbeat_stream(spark, f"{tmp_dir}/hb", f"{tmp_dir}/_ck", rows_per_second=5,
                              trigger_seconds=1)
    deadline = time.time() + 60
    while time.time() < deadline and not [p for p in q.recentProgress if p.get("numInputRows")]:
        time.sleep(1)
    q.stop()  # a rate source never runs dry: stop it, never wait for "all available"
    lines = [r["value"] for r in spark.read.text(f"{tmp_dir}/hb").collect()]
    assert lines and all(line[-4:] in ("AEDT", "AEST") and len(line) == 24 for line in lines)


def test_state_document_format(spark, tmp_dir):
    doc = ('{"version": 1, "last_updated": "2025-01-02T00:00:00Z", '
           '"window": {"start": "2020-01-03", "end": "2025-01-01"}, '
           '"tickers": {"BHP": {"status": "complete", "rows_written": 1250, "completed_at": "2025-01-02T00:00:00Z"}, '
           '"XYZ": {"status": "error", "error": "No data returned", "failed_at": "2025-01-02T00:00:01Z"}}}')
    os.makedirs(f"{tmp_dir}/doc")
    with open(f"{tmp_dir}/doc/state.json", "w") as f:
        f.write(doc)
    rows = {r["ticker"]: r for r in control.state_doc_table(control.read_state_doc(spark, f"{tmp_dir}/doc")).collect()}
    assert rows["BHP"]["rows_written"] == 1250 and rows["XYZ"]["status"] == "error"
    universe = spark.createDataFrame([("BHP", 0), ("XYZ", 1)], "ticker string, pos long")
    state = control.state_doc_table(control.read_state_doc(spark, f"{tmp_dir}/doc"))
    assert [r["ticker"] for r in control.pending_tickers(universe, state).collect()] == ["XYZ"]


def test_run_eda_writes_report_set(spark, sf_dir, tmp_dir):
    tables = reports.run_eda(faulted(spark, sf_dir), tmp_dir)
    for name in list(tables) + ["eda_summary"]:
        assert os.path.isdir(f"{tmp_dir}/{name}"), name
    cov = spark.read.option("header", True).csv(f"{tmp_dir}/ticker_coverage")
    assert cov.count() == 25

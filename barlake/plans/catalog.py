"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver tables (through the adaptors in
``sources.adaptors``) so its work grows with them; fixed run parameters
live in ``plans.frames``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import local_time, local_tz_abbreviation
from ..functions.keys import conformed_key, curated_snapshot_key, heartbeat_key, raw_key, trade_date_from_key
from ..operators import control, correlation, curate, normalise, promote, quality, returns, stats
from ..session import scratch_path, stored
from ..sources import adaptors
from ..sources.tables import read_table
from ..spec import RAW_BAR_SCHEMA
from . import frames
from .frames import AS_OF, BACKFILL_AS_OF, RUN_TS, SERIES_TICKER, WINDOW_DAYS

Q = SparkSession

# Registered outputs whose floats come from order-dependent sums (means, standard
# deviations, correlations) are reported to 6 decimals, the precision at which two
# engines agree; the operators themselves return full precision.
REPORT_DECIMALS = 6
DESCRIBE_FLOATS = ("mean", "std", "min", "p01", "p05", "p50", "p95", "p99", "max")


def rounded(df: DataFrame, cols, decimals: int = REPORT_DECIMALS) -> DataFrame:
    cols = set(cols)
    return df.select(*[F.round(F.col(c), decimals).alias(c) if c in cols else F.col(c) for c in df.columns])


# --- intake -----------------------------------------------------------------

def q_ticker_universe(spark: Q, sf: str) -> DataFrame:
    part = read_table(spark, sf, "part")
    lines = part.select(F.concat(F.lit(" "), F.lower("p_brand"), F.lit(" ")).alias("value"),
                        F.col("p_partkey").alias("pos"))
    return normalise.ticker_universe(lines)


def vendor_frame(spark: Q, sf: str) -> DataFrame:
    """lineitem rows shaped like a vendor download (capitalised columns, float volume)."""
    li = read_table(spark, sf, "lineitem")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    close = px * (F.lit(1.0) + F.col("l_tax") - F.col("l_discount"))
    return li.select(
        F.col("l_suppkey").cast("string").alias("ticker"),
        F.col("l_shipdate").alias("Date"),
        px.alias("Open"), (px * (F.lit(1.0) + F.col("l_tax"))).alias("High"),
        (px * (F.lit(1.0) - F.col("l_discount"))).alias("Low"), close.alias("Close"),
        (close * (F.lit(1.0) - F.col("l_discount"))).alias("Adj Close"),
        F.col("l_quantity").alias("Volume"))


def q_normalise_bars(spark: Q, sf: str) -> DataFrame:
    return normalise.normalise_bars(vendor_frame(spark, sf))


def _keys(spark: Q, sf: str) -> DataFrame:
    b = frames.bars(spark, sf).select(raw_key("dataset_id", "exchange", "trade_date", "ticker").alias("key"))
    i = adaptors.ingests(spark, sf).select(F.col("source_object_key").alias("key"))
    return b.unionByName(i)


def q_build_object_keys(spark: Q, sf: str) -> DataFrame:
    b = frames.bars(spark, sf)
    return b.select("ticker", "trade_date",
                    raw_key("dataset_id", "exchange", "trade_date", "ticker").alias("raw_key"),
                    conformed_key(raw_key("dataset_id", "exchange", "trade_date", "ticker")).alias("conformed_key"),
                    curated_snapshot_key("dataset_id", "exchange", "trade_date").alias("snapshot_key"))


def q_map_object_keys(spark: Q, sf: str) -> DataFrame:
    return _keys(spark, sf).select("key", conformed_key("key").alias("target_key"))


def q_dates_from_keys(spark: Q, sf: str) -> DataFrame:
    return (_keys(spark, sf).select(trade_date_from_key("key").alias("trade_date"))
            .where(F.col("trade_date").isNotNull()).distinct())


def q_heartbeat_keys(spark: Q, sf: str) -> DataFrame:
    """A heartbeat per order: instants in both halves of the year, so both abbreviations occur."""
    seconds = (F.col("o_orderkey") % 86_400).cast("int")
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).alias("ts"))
    body = F.concat(F.date_format(local_time("ts"), "yyyy-MM-dd HH:mm:ss"), F.lit(" "),
                    local_tz_abbreviation("ts"))
    return o.select("event_id", heartbeat_key("ts").alias("key"), body.alias("body"))


# --- promotion ----------------------------------------------------------------

def q_add_lineage(spark: Q, sf: str) -> DataFrame:
    return frames.conformed_bars(spark, sf).drop("row_hash")


def q_row_hash(spark: Q, sf: str) -> DataFrame:
    return frames.conformed_bars(spark, sf).select("ticker", "trade_date", "row_hash")


def _order_keys(orders: DataFrame) -> DataFrame:
    return orders.select(F.concat(F.lit("tabular/orders/order_date="), F.date_format("o_orderdate", "yyyy-MM-dd"),
                                  F.lit("/order="), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("key"),
                         "o_orderkey")


def q_incremental_new_keys(spark: Q, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders")
    raw = _order_keys(orders)
    li = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    existing = raw.join(li, "o_orderkey", "left_semi").select(conformed_key("key").alias("key"))
    return promote.new_objects(raw.select("key"), existing)


# --- control plane ------------------------------------------------------------

def _universe(spark: Q, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer")
    return normalise.ticker_universe(c.select(F.col("c_custkey").cast("string").alias("value"),
                                              F.col("c_custkey").alias("pos")))


def _outcome(spark: Q, sf: str) -> DataFrame:
    """One backfill run over the customers' orders, some of whose dates and prices do not parse."""
    vendor = adaptors.vendor_orders(spark, sf)
    faults = normalise.vendor_faults(vendor)
    fetched = normalise.normalise_bars(vendor.join(faults.select("ticker"), "ticker", "left_anti")).select("ticker", "trade_date")
    return control.run_backfill(_universe(spark, sf), fetched, BACKFILL_AS_OF, RUN_TS, faults=faults)


def q_backfill_state(spark: Q, sf: str) -> DataFrame:
    return _outcome(spark, sf)


def q_audit_errors(spark: Q, sf: str) -> DataFrame:
    return control.audit_errors(_outcome(spark, sf), BACKFILL_AS_OF, RUN_TS)


def q_audit_read_back(spark: Q, sf: str) -> DataFrame:
    """The audit written by two runs, read back: entries of both, by run date."""
    path = scratch_path(spark, "audit")
    outcome = stored(_outcome(spark, sf), "outcome")
    for as_of in (BACKFILL_AS_OF, "1996-07-31"):
        control.append_audit(control.audit_errors(outcome, as_of, RUN_TS), path)
    return control.read_audit(spark, path)


def q_pending_tickers(spark: Q, sf: str) -> DataFrame:
    return control.pending_tickers(_universe(spark, sf), _outcome(spark, sf))


def q_state_table(spark: Q, sf: str) -> DataFrame:
    return control.state_from_json(control.state_to_json(_outcome(spark, sf)))


# --- windows, unions, dedupe ----------------------------------------------------

def q_window_filter(spark: Q, sf: str) -> DataFrame:
    return normalise.window_filter(frames.bars(spark, sf), AS_OF, WINDOW_DAYS)


def q_last_n_bars(spark: Q, sf: str) -> DataFrame:
    return normalise.last_n_bars(frames.bars(spark, sf), 30)


def q_union_daily_backfill(spark: Q, sf: str) -> DataFrame:
    b = frames.bars(spark, sf)
    daily = b.where(F.dayofmonth("trade_date") % 2 == 0).drop("adj_close")
    backfill = b.where(F.dayofmonth("trade_date") % 2 == 1)
    return daily.unionByName(backfill, allowMissingColumns=True)


def q_exact_dedupe(spark: Q, sf: str) -> DataFrame:
    return curate.exact_dedupe(frames.hashed_ingests(spark, sf, frames.redelivered(spark, sf)))


def q_latest_wins_snapshot(spark: Q, sf: str) -> DataFrame:
    return curate.latest_wins(frames.hashed_ingests(spark, sf))


def q_latest_event(spark: Q, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    return curate.newest_object(ev, time_col="ts", key_col="event_id")


def _listing(spark: Q, sf: str, types) -> DataFrame:
    ev = read_table(spark, sf, "events").where(F.col("event_type").isin(*types))
    return curate.partition_freshness(ev.select(F.col("ts").cast("date").alias("trade_date"),
                                                F.col("ts").alias("modificationTime")))


def q_stale_partitions(spark: Q, sf: str) -> DataFrame:
    return curate.stale_partitions(_listing(spark, sf, ["view", "click", "purchase", "error"]),
                                   _listing(spark, sf, ["signup"]))


# --- curated scans ------------------------------------------------------------

def q_curated_scan(spark: Q, sf: str) -> DataFrame:
    """Batch curation of the conformed bars into per-date snapshots, read back as one table."""
    from ..sources.files import curated_scan
    path = scratch_path(spark, "curated")
    curate.build_snapshots(frames.conformed_bars(spark, sf), path)
    return curated_scan(spark, path)


def q_typed_bars(spark: Q, sf: str) -> DataFrame:
    """Bars as text (as a header-only CSV reader would give them), typed by the declared schema."""
    b = frames.bars(spark, sf)
    return normalise.typed_bars(b.select(*[F.col(c).cast("string").alias(c) for c in b.columns]))


def q_series_for_ticker(spark: Q, sf: str) -> DataFrame:
    return returns.series_for(frames.bars(spark, sf), "SYN", SERIES_TICKER)


def q_contract_report(spark: Q, sf: str) -> DataFrame:
    """A table that misses a column and holds another one with a wrong type."""
    return quality.contract_report(frames.conformed_bars(spark, sf).drop("adj_close").withColumn("volume", F.col("volume").cast("double")))


# --- quality ------------------------------------------------------------------

def q_table_profile(spark: Q, sf: str) -> DataFrame:
    return quality.table_profile(adaptors.ingests(spark, sf))


def q_duplicate_counts(spark: Q, sf: str) -> DataFrame:
    return quality.duplicate_counts(frames.redelivered(spark, sf))


def q_duplicate_rows(spark: Q, sf: str) -> DataFrame:
    return quality.duplicate_rows(adaptors.ingests(spark, sf), order=("ingest_ts", "source_object_key"))


def q_null_rates(spark: Q, sf: str) -> DataFrame:
    return quality.null_rates(frames.faulted(spark, sf))


def q_null_rates_by_ticker(spark: Q, sf: str) -> DataFrame:
    return quality.null_rates_by_ticker(frames.faulted(spark, sf))


def q_ticker_coverage(spark: Q, sf: str) -> DataFrame:
    return quality.ticker_coverage(frames.bars(spark, sf))


def q_worst_coverage_topk(spark: Q, sf: str) -> DataFrame:
    return quality.worst_coverage(quality.ticker_coverage(frames.bars(spark, sf)), 20)


def q_missing_business_days(spark: Q, sf: str) -> DataFrame:
    return quality.missing_business_days(frames.bars(spark, sf))


def q_ohlc_check_counts(spark: Q, sf: str) -> DataFrame:
    return quality.ohlc_check_counts(frames.faulted(spark, sf))


def q_ohlc_violations(spark: Q, sf: str) -> DataFrame:
    return quality.ohlc_violations(frames.faulted(spark, sf))


# --- price analytics ------------------------------------------------------------

def q_adj_drift(spark: Q, sf: str) -> DataFrame:
    return returns.adj_drift(frames.bars(spark, sf)).select("ticker", "trade_date", "adj_diff", "adj_diff_pct")


def q_adj_drift_describe(spark: Q, sf: str) -> DataFrame:
    return rounded(stats.describe(returns.adj_drift(frames.bars(spark, sf)), "adj_diff_pct"), DESCRIBE_FLOATS)


def q_histogram_adj_drift(spark: Q, sf: str) -> DataFrame:
    return stats.histogram(returns.adj_drift(frames.bars(spark, sf)), "adj_diff_pct")


def _faulted_returns(spark: Q, sf: str) -> DataFrame:
    return returns.daily_returns(frames.faulted(spark, sf))


def q_daily_returns(spark: Q, sf: str) -> DataFrame:
    return _faulted_returns(spark, sf).select("exchange", "ticker", "trade_date", "adj_close", "ret_1d")


def q_returns_describe(spark: Q, sf: str) -> DataFrame:
    return rounded(stats.describe(_faulted_returns(spark, sf), "ret_1d"), DESCRIBE_FLOATS)


def q_return_zscores(spark: Q, sf: str) -> DataFrame:
    return rounded(returns.return_zscores(_faulted_returns(spark, sf)).select(
        "exchange", "ticker", "trade_date", "ret_1d", "ret_z"), ["ret_z"])


def q_return_anomalies(spark: Q, sf: str) -> DataFrame:
    return rounded(returns.return_anomalies(returns.return_zscores(_faulted_returns(spark, sf))), ["ret_z"])


def q_log_volume_describe(spark: Q, sf: str) -> DataFrame:
    return rounded(stats.describe(returns.log_volume(frames.faulted(spark, sf)), "log10_volume"), DESCRIBE_FLOATS)


def q_histogram_log_volume(spark: Q, sf: str) -> DataFrame:
    return stats.histogram(returns.log_volume(frames.faulted(spark, sf)), "log10_volume")


def q_median_volume(spark: Q, sf: str) -> DataFrame:
    q = stats.exact_quantiles(frames.faulted(spark, sf), "volume", [0.5], ["exchange", "ticker"])
    return q.select("exchange", "ticker", F.col("quantile").alias("median_volume"))


def q_top_coverage_ticker(spark: Q, sf: str) -> DataFrame:
    return returns.top_coverage_series(frames.bars(spark, sf))


# --- cross-series -----------------------------------------------------------------

def q_return_matrix(spark: Q, sf: str) -> DataFrame:
    return frames.user_matrix(spark, sf)


def q_tickers_min_obs(spark: Q, sf: str) -> DataFrame:
    return correlation.tickers_min_obs(frames.user_matrix(spark, sf))


def _corr(spark: Q, sf: str) -> DataFrame:
    m = frames.user_matrix(spark, sf)
    return correlation.return_correlation(m, min_obs_fraction=0.8, materialise=True)


def q_return_correlation(spark: Q, sf: str) -> DataFrame:
    return rounded(_corr(spark, sf), ["corr"])


def q_histogram_correlation(spark: Q, sf: str) -> DataFrame:
    return rounded(correlation.correlation_histogram(frames.user_matrix(spark, sf), min_obs_fraction=0.8), ["bin_lo", "bin_hi"])


QUERIES = {
    "ticker_universe": q_ticker_universe,
    "normalise_bars": q_normalise_bars,
    "build_object_keys": q_build_object_keys,
    "map_object_keys": q_map_object_keys,
    "dates_from_keys": q_dates_from_keys,
    "heartbeat_keys": q_heartbeat_keys,
    "add_lineage": q_add_lineage,
    "row_hash": q_row_hash,
    "incremental_new_keys": q_incremental_new_keys,
    "pending_tickers": q_pending_tickers,
    "audit_errors": q_audit_errors,
    "backfill_state": q_backfill_state,
    "state_table": q_state_table,
    "window_filter": q_window_filter,
    "last_n_bars": q_last_n_bars,
    "union_daily_backfill": q_union_daily_backfill,
    "exact_dedupe": q_exact_dedupe,
    "latest_wins_snapshot": q_latest_wins_snapshot,
    "latest_event": q_latest_event,
    "stale_partitions": q_stale_partitions,
    "curated_scan": q_curated_scan,
    "typed_bars": q_typed_bars,
    "series_for_ticker": q_series_for_ticker,
    "contract_report": q_contract_report,
    "table_profile": q_table_profile,
    "duplicate_counts": q_duplicate_counts,
    "duplicate_rows": q_duplicate_rows,
    "null_rates": q_null_rates,
    "null_rates_by_ticker": q_null_rates_by_ticker,
    "ticker_coverage": q_ticker_coverage,
    "worst_coverage_topk": q_worst_coverage_topk,
    "missing_business_days": q_missing_business_days,
    "ohlc_check_counts": q_ohlc_check_counts,
    "ohlc_violations": q_ohlc_violations,
    "adj_drift": q_adj_drift,
    "adj_drift_describe": q_adj_drift_describe,
    "histogram_adj_drift": q_histogram_adj_drift,
    "daily_returns": q_daily_returns,
    "returns_describe": q_returns_describe,
    "return_zscores": q_return_zscores,
    "return_anomalies": q_return_anomalies,
    "log_volume_describe": q_log_volume_describe,
    "histogram_log_volume": q_histogram_log_volume,
    "median_volume": q_median_volume,
    "top_coverage_ticker": q_top_coverage_ticker,
    "return_matrix": q_return_matrix,
    "tickers_min_obs": q_tickers_min_obs,
    "return_correlation": q_return_correlation,
    "histogram_correlation": q_histogram_correlation,
}


def q_flagship_coverage(spark: Q, sf: str) -> DataFrame:
    from .flagship import flagship
    return flagship(spark, sf)


def all_queries() -> dict:
    out = dict(QUERIES)
    out["flagship_coverage"] = q_flagship_coverage
    from ..streaming import queries as stream_queries
    out.update(stream_queries.QUERIES)
    from . import lake_queries
    out.update(lake_queries.QUERIES)
    return out


# --- reports and listings -----------------------------------------------------------

def q_eda_summary(spark: Q, sf: str) -> DataFrame:
    from .reports import eda_summary
    return eda_summary(frames.faulted(spark, sf))


def q_newest_text_object(spark: Q, sf: str) -> DataFrame:
    from ..sources.files import newest_body
    return newest_body(adaptors.objects(spark, sf)).select("key", "modified", "content")


def q_quarantine_split(spark: Q, sf: str) -> DataFrame:
    """Landed CSV in which some records do not parse: (ticker, trade_date, parsed, faults) of all of them."""
    from ..sources.files import CORRUPT, FAULTS, read_raw_csv_quarantine
    path = scratch_path(spark, "landed")
    b = frames.user_bars(spark, sf).select(*RAW_BAR_SCHEMA.fieldNames())
    text = b.select(*[F.col(c).cast("string").alias(c) for c in b.columns])
    faulty = text.withColumn("open", F.when(F.dayofmonth("trade_date") == 13, F.lit("abc")).otherwise(F.col("open")))
    faulty.withColumn("volume", F.when(F.dayofmonth("trade_date").isin(13, 21), F.lit("many")).otherwise(F.col("volume"))).write.option("header", True).csv(path)
    good, bad = read_raw_csv_quarantine(spark, path)
    record = F.split(F.col(CORRUPT), ",")
    return (good.select("ticker", "trade_date", F.lit(True).alias("parsed"), F.lit(None).cast("string").alias("faults"))
            .unionByName(bad.select(record[2].alias("ticker"), record[5].cast("date").alias("trade_date"), F.lit(False).alias("parsed"), F.col(FAULTS).alias("faults"))))


def q_report_anomalies(spark: Q, sf: str) -> DataFrame:
    """Anomalies by z-score, each with the number of anomalies of its series that are more extreme downwards."""
    from pyspark.sql import Window
    found = returns.return_anomalies(returns.return_zscores(_faulted_returns(spark, sf)))
    w = Window.partitionBy("exchange", "ticker").orderBy("ret_z", "trade_date")
    return found.select("exchange", "ticker", "trade_date", F.round("ret_z", 6).alias("ret_z"), F.row_number().over(w).alias("position"))


def q_retention_candidates(spark: Q, sf: str) -> DataFrame:
    """Heartbeat keys (one per order) older than 7 days before a date in the middle of the range."""
    keys = q_heartbeat_keys(spark, sf).select("event_id", "key")
    return control.retention_candidates(keys, "1996-07-01", 7)


def q_universe_snapshot(spark: Q, sf: str) -> DataFrame:
    return control.universe_snapshot(q_ticker_universe(spark, sf), AS_OF)


QUERIES.update({
    "retention_candidates": q_retention_candidates,
    "universe_snapshot": q_universe_snapshot,
    "eda_summary": q_eda_summary,
    "newest_text_object": q_newest_text_object,
    "quarantine_split": q_quarantine_split,
    "audit_read_back": q_audit_read_back,
    "report_anomalies": q_report_anomalies,
})

"""DuckDB oracle SQL for the registered queries (same column names as the Spark side)."""

from __future__ import annotations

from . import lake_oracle
from .oracle_views import with_views

W = with_views

RAW_KEY = ("concat('tabular/', dataset_id, '/exchange=', exchange, '/trade_date=', "
           "strftime(trade_date, '%Y-%m-%d'), '/ticker=', ticker, '.csv')")


def conformed_key(k: str) -> str:
    return (f"CASE WHEN suffix({k}, '.csv') THEN concat(left({k}, length({k}) - 4), '.parquet') "
            f"ELSE concat({k}, '.parquet') END")


def price_text(c: str) -> str:
    """The exact text of a double (``functions.columns.exact_double_text``), from this engine's own hexadecimal form."""
    digits = f"replace(format('{{:a}}', {c}), 'p+', 'p')"
    return (f"CASE WHEN {c} IS NULL THEN 'nan' WHEN {c} = 0 THEN '0' "
            f"WHEN contains({digits}, '.') THEN {digits} ELSE replace({digits}, 'p', '.0p') END")


def text(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), 'nan')"


BAR_HASH = ("sha256(concat_ws('|', " + ", ".join([
    text("dataset_id"), text("exchange"), text("ticker"), "coalesce(strftime(trade_date, '%Y-%m-%d'), 'nan')",
    price_text("open"), price_text("high"), price_text("low"), price_text("close"),
    text("volume"), text("currency")]) + "))")

INGEST_HASH = ("sha256(concat_ws('|', " + ", ".join([
    text("dataset_id"), text("exchange"), text("ticker"), "coalesce(strftime(trade_date, '%Y-%m-%d'), 'nan')",
    price_text("px"), "''", "''", "''", text("q"), "''"]) + "))")

CONFORMED = f"""conformed AS (
  SELECT *, TIMESTAMP '2024-01-02 03:04:05' AS ingest_ts, 'manual__2024-01-02T03:04:05' AS ingest_batch_id,
         {RAW_KEY} AS source_object_key, {BAR_HASH} AS row_hash
  FROM bars_brand)"""

HINGESTS = f"hingests AS (SELECT *, {INGEST_HASH} AS row_hash FROM ingests)"
HREDELIVERED = f"hredelivered AS (SELECT *, {INGEST_HASH} AS row_hash FROM redelivered)"

KEYS = f"""keys AS (
  SELECT {RAW_KEY} AS key FROM bars_brand
  UNION ALL SELECT source_object_key AS key FROM ingests)"""

BEATS = """beats AS (SELECT o_orderkey AS event_id, CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400) AS ts FROM orders)"""
MEL = "timezone('Australia/Melbourne', ts AT TIME ZONE 'UTC')"

UNIVERSE = """universe AS (
  SELECT regexp_replace(upper(trim(CAST(c_custkey AS VARCHAR))), '[^A-Z0-9]', '', 'g') AS ticker,
         min(c_custkey) AS pos
  FROM customer GROUP BY 1 HAVING ticker <> '')"""

OUTCOME = """bad AS (
  SELECT CAST(o_custkey AS VARCHAR) AS ticker, count(*) AS n FROM orders WHERE o_orderkey % 997 = 0 OR o_orderkey % 991 = 0 GROUP BY 1),
fetched AS (
  SELECT CAST(o_custkey AS VARCHAR) AS ticker, count(*) AS rows_written FROM orders
  WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-06-30' - 1825 AND DATE '1996-06-30'
  GROUP BY 1),
done AS (
  SELECT u.ticker, f.rows_written, b.n, b.n IS NULL AND coalesce(f.rows_written, 0) > 0 AS ok
  FROM universe u LEFT JOIN fetched f ON f.ticker = u.ticker LEFT JOIN bad b ON b.ticker = u.ticker),
outcome AS (
  SELECT ticker, CASE WHEN ok THEN 'complete' ELSE 'error' END AS status,
         CASE WHEN ok THEN rows_written END AS rows_written,
         CASE WHEN ok THEN TIMESTAMP '2024-01-02 03:04:05' END AS completed_at,
         CASE WHEN ok THEN NULL WHEN n IS NOT NULL THEN concat('Unparsable rows: ', CAST(n AS VARCHAR)) ELSE 'No data returned' END AS error,
         CASE WHEN ok THEN NULL ELSE TIMESTAMP '2024-01-02 03:04:05' END AS failed_at
  FROM done)"""

RETURNS_OF = """{name} AS (
  SELECT *, p / nullif(lag(p) OVER (PARTITION BY exchange, ticker ORDER BY trade_date), 0) - 1 AS ret_1d
  FROM (SELECT *, last_value(adj_close IGNORE NULLS) OVER (PARTITION BY exchange, ticker ORDER BY trade_date
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM {src}))"""

FRET = RETURNS_OF.format(name="fret", src="faulted")
URET = RETURNS_OF.format(name="uret", src="bars_user")
ZS = """zs AS (
  SELECT *, (ret_1d - avg(ret_1d) OVER (PARTITION BY exchange, ticker))
            / nullif(stddev_pop(ret_1d) OVER (PARTITION BY exchange, ticker), 0) AS ret_z
  FROM fret)"""

MATRIX = """m AS (SELECT trade_date, ticker, avg(ret_1d) AS ret_1d FROM uret WHERE ret_1d IS NOT NULL GROUP BY 1, 2)"""
ELIG = """elig AS (
  SELECT ticker, count(ret_1d) AS n_obs, CAST(floor((SELECT count(DISTINCT trade_date) FROM m) * 0.8) AS BIGINT) AS min_obs
  FROM m GROUP BY ticker HAVING count(ret_1d) >= min_obs)"""
CORR = """mm AS (SELECT * FROM m WHERE ticker IN (SELECT ticker FROM elig)),
pr AS (SELECT a.ticker AS ta, b.ticker AS tb, a.ret_1d AS x, b.ret_1d AS y
       FROM mm a JOIN mm b ON a.trade_date = b.trade_date AND a.ticker <= b.ticker),
pc AS (SELECT ta, tb, count(*) AS n, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS c
       FROM pr GROUP BY ta, tb),
corr AS (SELECT e1.ticker AS ticker_a, e2.ticker AS ticker_b, coalesce(pc.n, 0) AS n_obs,
                greatest(-1.0, least(1.0, pc.c)) AS corr
         FROM elig e1 JOIN elig e2 ON e1.ticker <= e2.ticker
         LEFT JOIN pc ON pc.ta = e1.ticker AND pc.tb = e2.ticker)"""

PCTS = ((0.01, "p01"), (0.05, "p05"), (0.5, "p50"), (0.95, "p95"), (0.99, "p99"))


def describe_sql(src: str, col: str) -> str:
    q = ", ".join(f"quantile_cont({col}, {p}) AS {n}" for p, n in PCTS)
    return (f"SELECT count({col}) AS count, avg({col}) AS mean, stddev_samp({col}) AS std, min({col}) AS min, "
            f"{q}, max({col}) AS max FROM {src}")


def histogram_sql(src: str, col: str, weight: str = "1", bins: int = 80) -> str:
    return f"""v AS (SELECT {col} AS x, {weight} AS w FROM {src} WHERE {col} IS NOT NULL),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((x - lo) * {bins} / (hi - lo)) AS INTEGER), {bins - 1}) END AS bin,
             w FROM v, r),
n AS (SELECT bin, sum(w) AS total FROM b GROUP BY bin)
SELECT CAST(e.bin AS INTEGER) AS bin, lo + e.bin * (hi - lo) / {bins} AS bin_lo, lo + (e.bin + 1) * (hi - lo) / {bins} AS bin_hi,
       CAST(coalesce(total, 0) AS BIGINT) AS count
FROM range({bins}) AS e(bin) CROSS JOIN r LEFT JOIN n ON n.bin = e.bin"""


# Counted day by day, not by the closed form that Spark evaluates.
BUSINESS_DAYS = """(SELECT count(*) FROM (SELECT unnest(generate_series(CAST(start AS TIMESTAMP), CAST("end" AS TIMESTAMP), INTERVAL 1 DAY)) AS d) WHERE isodow(d) <= 5)"""
COVERAGE = f"""cov0 AS (
  SELECT exchange, ticker, count(*) AS rows, min(trade_date) AS start, max(trade_date) AS "end"
  FROM bars_brand GROUP BY exchange, ticker),
cov AS (
  SELECT exchange, ticker, rows, start, "end", CAST(expected_bdays AS INTEGER) AS expected_bdays,
         CAST(expected_bdays - rows AS BIGINT) AS missing_bdays
  FROM (SELECT *, {BUSINESS_DAYS} AS expected_bdays FROM cov0))"""

ORACLE: dict[str, str] = {
    "ticker_universe": """
SELECT regexp_replace(upper(trim(concat(' ', lower(p_brand), ' '))), '[^A-Z0-9]', '', 'g') AS ticker,
       min(p_partkey) AS pos
FROM part GROUP BY 1 HAVING ticker <> ''""",

    "normalise_bars": """
SELECT 'market_ohlcv_daily' AS dataset_id, 'ASX' AS exchange, CAST(l_suppkey AS VARCHAR) AS ticker,
       concat(CAST(l_suppkey AS VARCHAR), '.AX') AS vendor_symbol, 'AUD' AS currency,
       CAST(l_shipdate AS DATE) AS trade_date,
       l_extendedprice / l_quantity AS open, l_extendedprice / l_quantity * (1 + l_tax) AS high,
       l_extendedprice / l_quantity * (1 - l_discount) AS low,
       l_extendedprice / l_quantity * (1 + l_tax - l_discount) AS close,
       CAST(trunc(l_quantity) AS BIGINT) AS volume,
       l_extendedprice / l_quantity * (1 + l_tax - l_discount) * (1 - l_discount) AS adj_close
FROM lineitem""",

    "build_object_keys": W(["bars_brand"]) + f"""
SELECT ticker, trade_date, {RAW_KEY} AS raw_key, {conformed_key(RAW_KEY)} AS conformed_key,
       concat('tabular/', dataset_id, '/exchange=', exchange, '/trade_date=', strftime(trade_date, '%Y-%m-%d'),
              '/snapshot.parquet') AS snapshot_key
FROM bars_brand""",

    "map_object_keys": W(["bars_brand", "ingests"], KEYS) + f"""
SELECT key, {conformed_key('key')} AS target_key FROM keys""",

    "dates_from_keys": W(["bars_brand", "ingests"], KEYS) + """
SELECT DISTINCT d AS trade_date FROM (
  SELECT CASE WHEN contains(key, 'trade_date=') AND regexp_matches(regexp_extract(key, 'trade_date=([^/]*)', 1), '^.{4}-.{2}-.{2}$')
              THEN regexp_extract(key, 'trade_date=([^/]*)', 1) END AS d FROM keys)
WHERE d IS NOT NULL""",

    "heartbeat_keys": f"""
WITH {BEATS}
SELECT event_id, concat('heartbeat/airflow_time_', strftime({MEL}, '%Y%m%d_%H%M%S'), '.txt') AS key,
       concat(strftime({MEL}, '%Y-%m-%d %H:%M:%S'), ' ',
              CASE WHEN {MEL} - ts > INTERVAL '10 hours' THEN 'AEDT' ELSE 'AEST' END) AS body
FROM beats""",

    "add_lineage": W(["bars_brand"], CONFORMED) + "SELECT * EXCLUDE (row_hash) FROM conformed",

    "row_hash": W(["bars_brand"], CONFORMED) + "SELECT ticker, trade_date, row_hash FROM conformed",

    "incremental_new_keys": """
WITH raw AS (
  SELECT concat('tabular/orders/order_date=', strftime(o_orderdate, '%Y-%m-%d'), '/order=',
                CAST(o_orderkey AS VARCHAR), '.csv') AS key, o_orderkey FROM orders),
existing AS (
  SELECT DISTINCT concat(left(key, length(key) - 4), '.parquet') AS target_key FROM raw
  WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT concat(left(key, length(key) - 4), '.parquet') AS target_key, key FROM raw
WHERE concat(left(key, length(key) - 4), '.parquet') NOT IN (SELECT target_key FROM existing)""",

    "backfill_state": "WITH " + UNIVERSE + ",\n" + OUTCOME + "\nSELECT * FROM outcome",

    "state_table": "WITH " + UNIVERSE + ",\n" + OUTCOME + "\nSELECT * FROM outcome",

    "audit_errors": "WITH " + UNIVERSE + ",\n" + OUTCOME + """
SELECT DATE '1996-06-30' AS run_date, ticker, concat(ticker, '.AX') AS vendor_symbol,
       DATE '1996-06-30' - 1825 AS window_start, DATE '1996-06-30' AS window_end, error,
       TIMESTAMP '2024-01-02 03:04:05' AS ts
FROM outcome WHERE status = 'error'""",

    "pending_tickers": "WITH " + UNIVERSE + ",\n" + OUTCOME + """
SELECT * FROM universe WHERE ticker NOT IN (SELECT ticker FROM outcome WHERE status = 'complete')""",

    "window_filter": W(["bars_brand"]) + """
SELECT * FROM bars_brand WHERE trade_date BETWEEN DATE '2001-11-04' - 45 AND DATE '2001-11-04'""",

    "last_n_bars": W(["bars_brand"]) + """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY exchange, ticker ORDER BY trade_date DESC) AS rn FROM bars_brand)
WHERE rn <= 30""",

    "union_daily_backfill": W(["bars_brand"]) + """
SELECT * EXCLUDE (adj_close) FROM bars_brand WHERE day(trade_date) % 2 = 0
UNION ALL BY NAME
SELECT * FROM bars_brand WHERE day(trade_date) % 2 = 1""",

    "exact_dedupe": W(["redelivered"], HREDELIVERED) + """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, exchange, ticker, trade_date, row_hash
                               ORDER BY ingest_ts NULLS LAST, source_object_key) AS rn FROM hredelivered)
WHERE rn = 1""",

    "latest_wins_snapshot": W(["ingests"], HINGESTS) + """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, exchange, ticker, trade_date
                               ORDER BY ingest_ts DESC NULLS LAST, source_object_key DESC, row_hash DESC) AS rn
  FROM hingests)
WHERE rn = 1""",

    "latest_event": """
SELECT event_id, ts, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1""",

    "stale_partitions": """
WITH c AS (SELECT CAST(ts AS DATE) AS trade_date, max(ts) AS conformed_modified FROM events
           WHERE event_type IN ('view', 'click', 'purchase', 'error') GROUP BY 1),
     s AS (SELECT CAST(ts AS DATE) AS trade_date, max(ts) AS snapshot_modified FROM events
           WHERE event_type = 'signup' GROUP BY 1)
SELECT c.trade_date, conformed_modified, snapshot_modified FROM c LEFT JOIN s USING (trade_date)
WHERE snapshot_modified IS NULL OR snapshot_modified < conformed_modified""",

    "typed_bars": W(["bars_brand"]) + "SELECT * FROM bars_brand",

    "series_for_ticker": W(["bars_brand"]) + """
SELECT trade_date, adj_close FROM bars_brand
WHERE exchange = 'SYN' AND ticker = 'Brand#13' AND adj_close IS NOT NULL""",

    "contract_report": W(["bars_brand"], CONFORMED) + """
, req(position, column_name, present, data_type) AS (VALUES
  (0, 'dataset_id', true, 'string'), (1, 'exchange', true, 'string'), (2, 'ticker', true, 'string'),
  (3, 'vendor_symbol', true, 'string'), (4, 'currency', true, 'string'), (5, 'trade_date', true, 'date'),
  (6, 'open', true, 'double'), (7, 'high', true, 'double'), (8, 'low', true, 'double'),
  (9, 'close', true, 'double'), (10, 'volume', true, 'double'), (11, 'adj_close', false, NULL),
  (12, 'ingest_ts', true, 'timestamp'), (13, 'ingest_batch_id', true, 'string'),
  (14, 'source_object_key', true, 'string'), (15, 'row_hash', true, 'string')),
nn AS (UNPIVOT (SELECT count(dataset_id) AS dataset_id, count(exchange) AS exchange, count(ticker) AS ticker,
                       count(vendor_symbol) AS vendor_symbol, count(currency) AS currency,
                       count(trade_date) AS trade_date, count(open) AS open, count(high) AS high,
                       count(low) AS low, count(close) AS close, count(volume) AS volume,
                       count(ingest_ts) AS ingest_ts, count(ingest_batch_id) AS ingest_batch_id,
                       count(source_object_key) AS source_object_key, count(row_hash) AS row_hash
                FROM conformed)
       ON COLUMNS(*) INTO NAME column_name VALUE non_null)
SELECT position, req.column_name, present, data_type,
       CASE req.column_name WHEN 'volume' THEN 'bigint' WHEN 'adj_close' THEN 'double' ELSE data_type END AS declared_type, non_null,
       CASE WHEN NOT present THEN 'missing' WHEN req.column_name = 'volume' THEN 'wrong_type' WHEN non_null = 0 THEN 'all_null' ELSE 'ok' END AS status
FROM req LEFT JOIN nn ON req.column_name = nn.column_name""",

    "table_profile": W(["ingests"]) + """
SELECT count(*) AS rows, 8 AS cols, count(DISTINCT exchange) AS exchanges, count(DISTINCT ticker) AS tickers,
       min(trade_date) AS date_min, max(trade_date) AS date_max,
       min(ingest_ts) AS ingest_ts_min, max(ingest_ts) AS ingest_ts_max
FROM ingests""",

    "duplicate_counts": W(["redelivered"]) + """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT exchange, ticker, trade_date FROM redelivered)) AS BIGINT)
         AS duplicate_business_keys,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM redelivered)) AS BIGINT) AS duplicate_full_rows
FROM redelivered""",

    "duplicate_rows": W(["ingests"]) + """
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY exchange, ticker, trade_date) AS key_rows,
                      row_number() OVER (PARTITION BY exchange, ticker, trade_date ORDER BY ingest_ts, source_object_key) = 1 AS first_kept FROM ingests)
WHERE key_rows > 1""",

    "null_rates": W(["faulted"]) + """
SELECT column_name, null_count, null_count / (SELECT count(*) FROM faulted) AS null_rate FROM (
  UNPIVOT (SELECT count_if(dataset_id IS NULL) AS dataset_id, count_if(exchange IS NULL) AS exchange,
                  count_if(ticker IS NULL) AS ticker, count_if(vendor_symbol IS NULL) AS vendor_symbol,
                  count_if(currency IS NULL) AS currency, count_if(trade_date IS NULL) AS trade_date,
                  count_if(open IS NULL) AS open, count_if(high IS NULL) AS high, count_if(low IS NULL) AS low,
                  count_if(close IS NULL) AS close, count_if(volume IS NULL) AS volume,
                  count_if(adj_close IS NULL) AS adj_close FROM faulted)
  ON COLUMNS(*) INTO NAME column_name VALUE null_count)""",

    "null_rates_by_ticker": W(["faulted"]) + """
SELECT ticker, avg(CASE WHEN open IS NULL THEN 1.0 ELSE 0.0 END) AS open,
       avg(CASE WHEN high IS NULL THEN 1.0 ELSE 0.0 END) AS high,
       avg(CASE WHEN low IS NULL THEN 1.0 ELSE 0.0 END) AS low,
       avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) AS close,
       avg(CASE WHEN volume IS NULL THEN 1.0 ELSE 0.0 END) AS volume,
       avg(CASE WHEN adj_close IS NULL THEN 1.0 ELSE 0.0 END) AS adj_close
FROM faulted GROUP BY ticker""",

    "ticker_coverage": W(["bars_brand"], COVERAGE) + "SELECT * FROM cov",

    "worst_coverage_topk": W(["bars_brand"], COVERAGE) + """
SELECT * FROM cov ORDER BY missing_bdays DESC, rows ASC, exchange, ticker LIMIT 20""",

    "missing_business_days": W(["bars_brand"], COVERAGE) + """
, cal AS (SELECT exchange, ticker, CAST(unnest(generate_series(start, "end", INTERVAL 1 DAY)) AS DATE) AS trade_date
          FROM cov)
SELECT exchange, ticker, trade_date FROM cal
WHERE isodow(trade_date) <= 5
  AND NOT EXISTS (SELECT 1 FROM bars_brand b WHERE b.exchange = cal.exchange AND b.ticker = cal.ticker
                  AND b.trade_date = cal.trade_date)""",

    "ohlc_check_counts": W(["faulted"]) + """
SELECT count_if(coalesce(open < 0, false) OR coalesce(high < 0, false) OR coalesce(low < 0, false)
                OR coalesce(close < 0, false) OR coalesce(adj_close < 0, false)) AS rows_with_negative_price,
       count_if(coalesce(volume < 0, false)) AS rows_with_negative_volume,
       count_if(coalesce(low > least(open, close), false) OR coalesce(high < greatest(open, close), false)
                OR coalesce(low > high, false)) AS rows_failing_ohlc_bounds
FROM faulted""",

    "ohlc_violations": W(["faulted"]) + """
SELECT * FROM (
  SELECT *, coalesce(open < 0, false) OR coalesce(high < 0, false) OR coalesce(low < 0, false)
            OR coalesce(close < 0, false) OR coalesce(adj_close < 0, false) AS negative_price,
         coalesce(volume < 0, false) AS negative_volume,
         coalesce(low > least(open, close), false) OR coalesce(high < greatest(open, close), false)
            OR coalesce(low > high, false) AS ohlc_inversion
  FROM faulted)
WHERE negative_price OR negative_volume OR ohlc_inversion""",

    "adj_drift": W(["bars_brand"]) + """
SELECT ticker, trade_date, adj_close - close AS adj_diff, (adj_close - close) / nullif(close, 0) AS adj_diff_pct
FROM bars_brand""",

    "adj_drift_describe": W(["bars_brand"], "d AS (SELECT (adj_close - close) / nullif(close, 0) AS x FROM bars_brand)")
    + describe_sql("d", "x"),

    "histogram_adj_drift": W(["bars_brand"], "d AS (SELECT (adj_close - close) / nullif(close, 0) AS x FROM bars_brand)",
                             histogram_sql("d", "x")),

    "daily_returns": W(["faulted"], FRET) + "SELECT exchange, ticker, trade_date, adj_close, ret_1d FROM fret",

    "returns_describe": W(["faulted"], FRET) + describe_sql("fret", "ret_1d"),

    "return_zscores": W(["faulted"], FRET, ZS) + "SELECT exchange, ticker, trade_date, ret_1d, ret_z FROM zs",

    "return_anomalies": W(["faulted"], FRET, ZS) + """
SELECT exchange, ticker, trade_date, adj_close, ret_1d, ret_z, volume FROM zs WHERE abs(ret_z) >= 6""",

    "log_volume_describe": W(["faulted"], "lv AS (SELECT CASE WHEN volume > 0 THEN log10(volume) END AS x FROM faulted)")
    + describe_sql("lv", "x"),

    "histogram_log_volume": W(["faulted"], "lv AS (SELECT CASE WHEN volume > 0 THEN log10(volume) END AS x FROM faulted)",
                              histogram_sql("lv", "x")),

    "median_volume": W(["faulted"]) + """
SELECT exchange, ticker, median(CAST(volume AS DOUBLE)) AS median_volume FROM faulted GROUP BY exchange, ticker""",

    "top_coverage_ticker": W(["bars_brand"]) + """
SELECT exchange, ticker, count(*) AS rows FROM bars_brand GROUP BY exchange, ticker
ORDER BY rows DESC, exchange, ticker LIMIT 1""",

    "return_matrix": W(["bars_user"], URET, MATRIX) + "SELECT * FROM m",

    "tickers_min_obs": W(["bars_user"], URET, MATRIX, ELIG) + "SELECT * FROM elig",

    "return_correlation": W(["bars_user"], URET, MATRIX, ELIG, CORR) + "SELECT * FROM corr",

    "histogram_correlation": W(["bars_user"], URET, MATRIX, ELIG, CORR,
                               histogram_sql("(SELECT * FROM corr WHERE ticker_a <> ticker_b)", "corr", weight="2")),
}

ORACLE["flagship_coverage"] = W(["ingests"], HINGESTS) + f"""
, winners AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset_id, exchange, ticker, trade_date
                                 ORDER BY ingest_ts DESC NULLS LAST, source_object_key DESC, row_hash DESC) AS rn FROM hingests) WHERE rn = 1),
cov0 AS (SELECT exchange, ticker, count(*) AS rows, min(trade_date) AS start, max(trade_date) AS "end", max_by(row_hash, trade_date) AS last_row_hash,
                max_by(source_object_key, trade_date) AS last_source_object_key, max(ingest_ts) AS last_ingest_ts FROM winners GROUP BY exchange, ticker)
SELECT exchange, ticker, rows, start, "end", CAST(expected AS INTEGER) AS expected_bdays, CAST(expected - rows AS BIGINT) AS missing_bdays,
       last_row_hash, last_source_object_key, last_ingest_ts
FROM (SELECT *, {BUSINESS_DAYS} AS expected FROM cov0)"""
ORACLE["stream_copy_promote"] = "SELECT * FROM events"
ORACLE["stream_raw_to_conformed"] = W(["bars_brand"], CONFORMED) + "SELECT * FROM conformed"
ORACLE["stream_snapshot_refresh"] = ORACLE["latest_wins_snapshot"]

FMATRIX = "fm AS (SELECT trade_date, ticker, avg(ret_1d) AS ret_1d FROM fret WHERE ret_1d IS NOT NULL GROUP BY 1, 2)"
ORACLE["eda_summary"] = W(["faulted"], FRET, ZS, FMATRIX) + """
, met AS (
  SELECT (SELECT count(*) FROM faulted) AS rows, (SELECT count(DISTINCT ticker) FROM faulted) AS tickers,
         (SELECT min(trade_date) FROM faulted) AS date_min, (SELECT max(trade_date) FROM faulted) AS date_max,
         CAST((SELECT count(*) FROM faulted)
              - (SELECT count(*) FROM (SELECT DISTINCT exchange, ticker, trade_date FROM faulted)) AS BIGINT)
           AS duplicate_business_keys,
         (SELECT count_if(coalesce(open < 0, false) OR coalesce(high < 0, false) OR coalesce(low < 0, false)
                 OR coalesce(close < 0, false) OR coalesce(adj_close < 0, false)) FROM faulted) AS rows_with_negative_price,
         (SELECT count_if(coalesce(volume < 0, false)) FROM faulted) AS rows_with_negative_volume,
         (SELECT count_if(coalesce(low > least(open, close), false) OR coalesce(high < greatest(open, close), false)
                 OR coalesce(low > high, false)) FROM faulted) AS rows_failing_ohlc_bounds,
         (SELECT count(*) FROM zs WHERE abs(ret_z) >= 6) AS return_anomalies,
         (SELECT count(DISTINCT trade_date) FROM fm) AS matrix_dates, (SELECT count(DISTINCT ticker) FROM fm) AS matrix_tickers,
         (SELECT count(*) FROM (SELECT ticker FROM fm GROUP BY ticker
                                HAVING count(ret_1d) >= floor((SELECT count(DISTINCT trade_date) FROM fm) * 0.8)))
           AS correlation_tickers)
SELECT *, concat_ws(chr(10),
  'Rows: ' || format('{:,}', rows), 'Tickers: ' || format('{:,}', tickers),
  'Date range: ' || strftime(date_min, '%Y-%m-%d') || ' to ' || strftime(date_max, '%Y-%m-%d'),
  'Duplicate business keys (exchange,ticker,trade_date): ' || format('{:,}', duplicate_business_keys),
  'Rows failing OHLC bounds: ' || format('{:,}', rows_failing_ohlc_bounds),
  'Rows with negative price: ' || format('{:,}', rows_with_negative_price),
  'Rows with negative volume: ' || format('{:,}', rows_with_negative_volume),
  'Return anomalies (|z|>=6): ' || format('{:,}', return_anomalies),
  'Correlation matrix tickers (>=80% obs): ' || format('{:,}', correlation_tickers)) AS summary
FROM met"""

ORACLE["retention_candidates"] = f"""
WITH {BEATS}
SELECT * FROM (
  SELECT event_id, concat('heartbeat/airflow_time_', strftime({MEL}, '%Y%m%d_%H%M%S'), '.txt') AS key,
         CAST(strftime({MEL}, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS object_time
  FROM beats)
WHERE object_time < CAST(DATE '1996-07-01' - 7 AS TIMESTAMP)"""

ORACLE["universe_snapshot"] = ORACLE["ticker_universe"].replace(
    "min(p_partkey) AS pos", "min(p_partkey) AS pos, DATE '2001-11-04' AS constituents_snapshot_date")

ORACLE["curated_scan"] = W(["bars_brand"], CONFORMED) + "SELECT * FROM conformed"


ORACLE["audit_read_back"] = " UNION ALL ".join("SELECT * FROM (" + ORACLE["audit_errors"].replace(
    "DATE '1996-06-30' AS run_date", f"DATE '{d}' AS run_date").replace("DATE '1996-06-30' - 1825 AS window_start, DATE '1996-06-30' AS window_end",
                                                                        f"DATE '{d}' - 1825 AS window_start, DATE '{d}' AS window_end") + ")" for d in ("1996-06-30", "1996-07-31"))

ORACLE["newest_text_object"] = W(["objects"]) + "SELECT key, modified, content FROM objects ORDER BY modified DESC, key DESC LIMIT 1"

ORACLE["copy_new_objects"] = W(["objects"]) + "SELECT key, content, CASE WHEN length % 3 = 0 THEN 1 ELSE 2 END AS delivery FROM objects"

ORACLE["quarantine_split"] = W(["bars_user"]) + """
SELECT ticker, trade_date, day(trade_date) NOT IN (13, 21) AS parsed, CASE day(trade_date) WHEN 13 THEN 'open,volume' WHEN 21 THEN 'volume' END AS faults FROM bars_user"""

ORACLE["report_nulls_by_ticker"] = "SELECT *, row_number() OVER (ORDER BY close DESC, ticker) AS position FROM (" + ORACLE["null_rates_by_ticker"] + ")"

ORACLE["report_anomalies"] = ("SELECT exchange, ticker, trade_date, round(ret_z, 6) AS ret_z, "
                              "row_number() OVER (PARTITION BY exchange, ticker ORDER BY ret_z, trade_date) AS position FROM (" + ORACLE["return_anomalies"] + ")")

def _rounded(sql: str, cols) -> str:
    """Same 6-decimal report precision as the Spark side (``catalog.rounded``)."""
    rep = ", ".join(f"round({c}, 6) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n)"


_DESCRIBE_FLOATS = ("mean", "std", "min", "p01", "p05", "p50", "p95", "p99", "max")
for _name in ("adj_drift_describe", "returns_describe", "log_volume_describe"):
    ORACLE[_name] = _rounded(ORACLE[_name], _DESCRIBE_FLOATS)
for _name in ("return_zscores", "return_anomalies"):
    ORACLE[_name] = _rounded(ORACLE[_name], ["ret_z"])
ORACLE["return_correlation"] = _rounded(ORACLE["return_correlation"], ["corr"])
ORACLE["histogram_correlation"] = _rounded(ORACLE["histogram_correlation"], ["bin_lo", "bin_hi"])
ORACLE.update(lake_oracle.statements(ORACLE, OUTCOME, UNIVERSE, RAW_KEY, price_text))

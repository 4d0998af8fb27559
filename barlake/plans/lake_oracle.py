"""DuckDB SQL of the queries that land data in zones (``lake_queries``): what the zones must hold, from the tables alone."""

from __future__ import annotations

from .oracle_views import with_views as W

TEXTS = """texts AS (
  SELECT CAST(doc_id % 28 AS INTEGER) AS day_number, DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER) AS trade_date, doc_id // (28 * 500) AS slice, doc_id,
         coalesce(text, '') AS value FROM documents),
text_objects AS (
  SELECT trade_date, slice, any_value(day_number) AS day_number, concat('trade_date=', strftime(trade_date, '%Y-%m-%d'), '/slice=', CAST(slice AS VARCHAR)) AS key,
         CAST(sum(strlen(value) + 1) AS BIGINT) AS length, sha256(string_agg(concat(value, chr(10)), '' ORDER BY doc_id, value)) AS sha256
  FROM texts GROUP BY ALL)"""


def statements(oracle: dict[str, str], outcome: str, universe: str, raw_key: str, price_text) -> dict[str, str]:
    bars_event_type = W(["bars_user"]).replace("user_id", "event_type").replace("bars_user", "bars_event_type")
    deliveries = W(["bars_user"]) + f"""
, b AS (SELECT *, {raw_key} AS source_object_key, CASE WHEN day(trade_date) % 7 = 0 THEN close + 1.5 ELSE close END AS later FROM bars_user),
modes(mode) AS (VALUES ('by_key'), ('by_content')),
d AS (SELECT mode, source_object_key, ticker, trade_date, close, 'first' AS ingest_batch_id FROM b, modes WHERE day(trade_date) % 2 = 0
      UNION ALL SELECT mode, source_object_key, ticker, trade_date, later, 'second' FROM b, modes WHERE day(trade_date) % 2 = 1 OR mode = 'by_content' AND later <> close
      UNION ALL SELECT mode, source_object_key, ticker, trade_date, close, 'third' FROM b, modes WHERE mode = 'by_content' AND later <> close)"""
    event_hash = ("sha256(concat_ws('|', 'user_events', event_type, strftime(event_date, '%Y-%m-%d'), CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), "
                  + price_text("value") + "))")
    eda = oracle["eda_summary"]
    return {
        "ticker_file": "SELECT DISTINCT regexp_replace(upper(trim(p_brand)), '[^A-Z0-9]', '', 'g') AS ticker FROM part",
        "refresh_window": W(["bars_user"]) + "SELECT trade_date, count(*) AS rows FROM bars_user WHERE trade_date BETWEEN DATE '2024-01-06' AND DATE '2024-01-15' GROUP BY 1",
        "coerced_ingest_times": "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN ts END AS ingest_ts FROM events",
        "sketch_profile": """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS rows, count(DISTINCT o_custkey) AS customers, true AS customers_within, true AS p50_within, true AS p99_within,
       min(o_totalprice) AS least, max(o_totalprice) AS greatest FROM orders GROUP BY 1""",
        "wide_matrix_export": oracle["return_matrix"].replace(
            "SELECT * FROM m", "SELECT *, (SELECT count(DISTINCT trade_date) FROM m) AS matrix_rows, (SELECT count(DISTINCT ticker) FROM m) AS matrix_columns FROM m"),
        "report_round_trip": f"""
WITH e AS ({eda}), r(report, rows, columns) AS (
  SELECT 'profile', 1, 6 UNION ALL SELECT 'ticker_coverage', tickers, 7 FROM e UNION ALL SELECT 'nulls_overall', 12, 3 UNION ALL SELECT 'nulls_by_ticker', tickers, 7 FROM e
  UNION ALL SELECT 'returns_describe', 1, 10 UNION ALL SELECT 'return_anomalies_z6', return_anomalies, 7 FROM e
  UNION ALL SELECT 'median_volume_by_ticker', tickers, 3 FROM e UNION ALL SELECT 'returns_correlation', correlation_tickers * (correlation_tickers + 1) // 2, 4 FROM e)
SELECT *, 0 AS differing FROM r""",
        "membership_intervals": """
WITH snap AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS ticker, make_date(year(o_orderdate), CASE WHEN month(o_orderdate) <= 6 THEN 6 ELSE 12 END, 30) AS d FROM orders),
num AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM (SELECT DISTINCT d FROM snap)),
isl AS (SELECT ticker, k, k - row_number() OVER (PARTITION BY ticker ORDER BY k) AS g FROM snap JOIN num USING (d)),
spell AS (SELECT ticker, min(k) AS a, max(k) + 1 AS b FROM isl GROUP BY ticker, g)
SELECT ticker, n.d AS entered, x.d AS "left" FROM spell JOIN num n ON n.k = a LEFT JOIN num x ON x.k = b""",
        "universe_as_of": """
SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS ticker, DATE '1997-12-30' AS constituents_snapshot_date FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) > 6""",
        "events_raw_to_curated": f"""
WITH ev AS (SELECT event_type, CAST(ts AS DATE) AS event_date, event_id, user_id, CASE WHEN event_id % 5 = 0 THEN value + 1.0 ELSE value END AS value,
                   CASE WHEN event_id % 2 = 0 AND (event_id % 5 <> 0 OR value + 1.0 = value) THEN 'first' ELSE 'second' END AS ingest_batch_id FROM events)
SELECT event_type, event_date, event_id, user_id, value, concat('tabular/user_events/event_type=', event_type, '/event_date=', strftime(event_date, '%Y-%m-%d'),
       '/event_id=', CAST(event_id AS VARCHAR), '.csv') AS source_object_key, {event_hash} AS row_hash, ingest_batch_id FROM ev""",
        "raw_layouts": W(["bars_user"]) + "SELECT * REPLACE (CASE WHEN day(trade_date) % 2 = 0 THEN NULL ELSE adj_close END AS adj_close) FROM bars_user",
        "object_inventory": f"WITH {TEXTS} SELECT key, trade_date, slice, length FROM text_objects",
        "storage_footprint": f"""WITH {TEXTS}
SELECT trade_date, count(*) AS objects, CAST(sum(length) AS BIGINT) AS bytes, max(length) AS largest, CAST(sum(length) AS DOUBLE) / count(*) AS mean_bytes FROM text_objects GROUP BY 1""",
        "listing_stale_partitions": f"""WITH {TEXTS}
SELECT DISTINCT trade_date, day_number % 3 = 0 AS has_snapshot FROM text_objects WHERE day_number % 3 <> 0 OR day_number % 2 = 0""",
        "promote_incremental": deliveries + """
SELECT *, TIMESTAMP '2024-01-02 03:04:05' + CASE ingest_batch_id WHEN 'first' THEN INTERVAL 0 DAY WHEN 'second' THEN INTERVAL 1 DAY ELSE INTERVAL 2 DAY END AS ingest_ts FROM d""",
        "restated_snapshot": deliveries + """
SELECT ticker, trade_date, close, CASE WHEN later <> close THEN 'third' WHEN day(trade_date) % 2 = 0 THEN 'first' ELSE 'second' END AS ingest_batch_id FROM b""",
        "stream_copy_objects": f"WITH {TEXTS} SELECT key, length, sha256 FROM text_objects",
        "state_compacted": f"""WITH {universe},
{outcome},
first_run AS (SELECT *, TIMESTAMP '2024-01-02 03:04:05' AS last_updated FROM outcome),
failed AS (SELECT ticker, CAST(ticker AS BIGINT) AS n FROM outcome WHERE status = 'error'),
runs AS (SELECT * FROM first_run
  UNION ALL SELECT ticker, 'complete', 2, TIMESTAMP '2024-01-03 03:04:05', NULL, NULL, TIMESTAMP '2024-01-03 03:04:05' FROM failed WHERE n % 2 = 0
  UNION ALL SELECT ticker, 'error', NULL, NULL, 'failed again', TIMESTAMP '2024-01-04 03:04:05', TIMESTAMP '2024-01-04 03:04:05' FROM failed WHERE n % 3 = 0)
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY last_updated DESC) AS k FROM runs) WHERE k = 1""",
        "state_documents": f"WITH {universe},\n{outcome}\nSELECT * FROM outcome",
        "reland_objects": bars_event_type + """
, x AS (SELECT *, day(trade_date) % 5 = 0 AND length(ticker) % 2 = 1 AS relanded FROM bars_event_type)
SELECT exchange, trade_date, ticker, CASE WHEN relanded THEN close + 2.5 ELSE close END AS close, 1 AS files, relanded FROM x""",
        "anomaly_ranking": "SELECT *, row_number() OVER (ORDER BY abs(ret_z) DESC, exchange, ticker, trade_date) AS position FROM (" + oracle["return_zscores"] + ") WHERE abs(ret_z) >= 2",
    }

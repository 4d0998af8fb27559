"""DuckDB-dialect SQL for the adaptor views, used to build oracle queries.

Each oracle query is ``WITH <views> SELECT ...`` over the driver tables that
DuckDB has registered under their own names.
"""

from __future__ import annotations

BARS_BRAND = """
bars_brand AS (
  WITH t AS (
    SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS trade_date,
           l_extendedprice / l_quantity AS px, l_quantity AS q, l_discount AS disc,
           row_number() OVER (PARTITION BY p_brand, CAST(l_shipdate AS DATE)
                              ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn
    FROM lineitem JOIN part ON p_partkey = l_partkey)
  SELECT 'market_ohlcv_daily' AS dataset_id, 'SYN' AS exchange, ticker,
         concat(ticker, '.AX') AS vendor_symbol, 'AUD' AS currency, trade_date,
         min_by(px, rn) AS open, max(px) AS high, min(px) AS low, max_by(px, rn) AS close,
         CAST(sum(q) AS BIGINT) AS volume,
         max_by(px, rn) * (1 - max_by(disc, rn)) AS adj_close
  FROM t GROUP BY ticker, trade_date)"""

BARS_USER = """
bars_user AS (
  WITH t AS (
    SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS trade_date, value AS px,
           row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn
    FROM events)
  SELECT 'market_ohlcv_daily' AS dataset_id, 'SYN' AS exchange, ticker,
         concat(ticker, '.AX') AS vendor_symbol, 'AUD' AS currency, trade_date,
         min_by(px, rn) AS open, max(px) AS high, min(px) AS low,
         max_by(px, rn) AS close, max_by(px, rn) AS adj_close, count(*) AS volume
  FROM t GROUP BY ticker, trade_date)"""

INGESTS = """
ingests AS (
  SELECT 'market_ohlcv_daily' AS dataset_id, 'SYN' AS exchange, p_brand AS ticker,
         CAST(l_shipdate AS DATE) AS trade_date,
         l_shipdate + l_orderkey * INTERVAL '1' SECOND AS ingest_ts,
         concat(CAST(l_orderkey AS VARCHAR), '/', CAST(l_linenumber AS VARCHAR), '/',
                CAST(l_partkey AS VARCHAR), '/', CAST(l_suppkey AS VARCHAR)) AS source_object_key,
         l_extendedprice / l_quantity AS px, CAST(l_quantity AS BIGINT) AS q
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""

FAULTED = """
faulted AS (
  SELECT dataset_id, exchange, ticker, vendor_symbol, currency, trade_date,
         CASE WHEN day(trade_date) = 11 THEN -open ELSE open END AS open,
         high,
         CASE WHEN day(trade_date) = 7 THEN high + 1 ELSE low END AS low,
         CASE WHEN day(trade_date) = 15 THEN NULL ELSE close END AS close,
         CASE WHEN day(trade_date) = 17 THEN -volume
              WHEN day(trade_date) = 19 THEN CAST(0 AS BIGINT) ELSE volume END AS volume,
         CASE WHEN day(trade_date) = 13 THEN NULL ELSE adj_close END AS adj_close
  FROM bars_brand)"""

REDELIVERED = """
redelivered AS (
  SELECT * FROM ingests
  UNION ALL SELECT * REPLACE (ingest_ts + INTERVAL 1 HOUR AS ingest_ts) FROM ingests WHERE q % 10 = 0
  UNION ALL SELECT * REPLACE (ingest_ts + INTERVAL 1 HOUR AS ingest_ts, px * (1.0::DOUBLE + pow(2.0, -50)) AS px) FROM ingests WHERE q % 11 = 0
  UNION ALL SELECT * FROM ingests WHERE q % 10 = 0)"""

OBJECTS = """
objects AS (
  SELECT concat('heartbeat/', coalesce(source, 'none'), '/doc_', CAST(doc_id AS VARCHAR), '.txt') AS key,
         CAST(strlen(text) AS BIGINT) AS length, make_timestamp((1704067200 + doc_id * 37 % 86400) * 1000000) AS modified, text AS content
  FROM documents)"""

VIEWS = {"bars_brand": BARS_BRAND, "bars_user": BARS_USER, "ingests": INGESTS, "faulted": FAULTED,
         "redelivered": REDELIVERED, "objects": OBJECTS}
DEPENDS = {"faulted": ["bars_brand"], "redelivered": ["ingests"]}


def with_views(names: list[str], *ctes: str) -> str:
    """``WITH`` prefix holding the named adaptor views (dependencies first) and extra CTEs."""
    ordered: list[str] = []
    for n in names:
        for dep in DEPENDS.get(n, []):
            if dep not in ordered:
                ordered.append(dep)
        if n not in ordered:
            ordered.append(n)
    parts = [VIEWS[n].strip() for n in ordered] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n"

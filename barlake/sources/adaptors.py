"""OHLCV-shaped views over the driver tables.

The lake ingests vendor bars; the driver ships TPC-H-shaped tables instead.
These adaptors derive bar tables from them so that every operator runs over
data whose size grows with the inputs:

* ``bars_brand``  one bar per (part brand, ship date) from lineitem x part
* ``bars_user``   one bar per (user, day) from events
* ``ingests``     one conformed-style ingest record per lineitem x part row,
                  i.e. many ingests per business key (for dedupe operators)
* ``faulted_bars`` deterministic nulls and rule violations on ``bars_brand``

Open/close pick the first/last line by a total order; this is expressed as
``min_by``/``max_by`` aggregates (partial aggregation on the map side, so a
hot (brand, date) group never lands whole in one task), not as a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import DATASET_ID, USER_EVENTS
from .tables import read_table

SYN_EXCHANGE = "SYN"
SYN_CURRENCY = "AUD"


def _line_order() -> Column:
    return F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def brand_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined to its part's brand; part is the small dimension side."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(part, li.l_partkey == part.p_partkey, "inner")


def bars_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = brand_lines(spark, sf_dir).select(
        F.col("p_brand").alias("ticker"),
        F.col("l_shipdate").cast("date").alias("trade_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.col("l_quantity").alias("q"),
        F.col("l_discount").alias("disc"),
        _line_order().alias("ord"),
    )
    agg = lines.groupBy("ticker", "trade_date").agg(
        F.min_by("px", "ord").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "ord").alias("close"),
        F.sum("q").cast("bigint").alias("volume"),
        F.max_by("disc", "ord").alias("last_disc"),
    )
    return agg.select(
        F.lit(DATASET_ID).alias("dataset_id"),
        F.lit(SYN_EXCHANGE).alias("exchange"),
        "ticker",
        F.concat("ticker", F.lit(".AX")).alias("vendor_symbol"),
        F.lit(SYN_CURRENCY).alias("currency"),
        "trade_date", "open", "high", "low", "close", "volume",
        (F.col("close") * (F.lit(1.0) - F.col("last_disc"))).alias("adj_close"),
    )


def bars_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_bars(spark, sf_dir, "user_id")


def bars_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per event type and day: few raw objects, whatever the number of events."""
    return _event_bars(spark, sf_dir, "event_type")


def _event_bars(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", by, "value")
    t = ev.select(
        F.col(by).cast("string").alias("ticker"),
        F.col("ts").cast("date").alias("trade_date"),
        F.col("value").alias("px"),
        F.struct("ts", "event_id").alias("ord"),
    )
    agg = t.groupBy("ticker", "trade_date").agg(
        F.min_by("px", "ord").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "ord").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )
    return agg.select(
        F.lit(DATASET_ID).alias("dataset_id"),
        F.lit(SYN_EXCHANGE).alias("exchange"),
        "ticker",
        F.concat("ticker", F.lit(".AX")).alias("vendor_symbol"),
        F.lit(SYN_CURRENCY).alias("currency"),
        "trade_date", "open", "high", "low", "close",
        F.col("close").alias("adj_close"), "volume",
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw rows of the dataset ``USER_EVENTS``."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.lit(USER_EVENTS.dataset_id).alias("dataset_id"), "event_type", F.col("ts").cast("date").alias("event_date"), "event_id", "user_id", "value")


def ingests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = brand_lines(spark, sf_dir)
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in
                             ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return lines.select(
        F.lit(DATASET_ID).alias("dataset_id"),
        F.lit(SYN_EXCHANGE).alias("exchange"),
        F.col("p_brand").alias("ticker"),
        F.col("l_shipdate").cast("date").alias("trade_date"),
        (F.col("l_shipdate") + F.col("l_orderkey") * F.expr("INTERVAL '1' SECOND")).alias("ingest_ts"),
        key.alias("source_object_key"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.col("l_quantity").cast("bigint").alias("q"),
    )


# Deterministic faults, keyed by day of month of trade_date.
FAULT_DAYS = {"adj_close_null": 13, "close_null": 15, "low_above_high": 7,
              "negative_open": 11, "negative_volume": 17, "zero_volume": 19}


def faulted_bars(bars: DataFrame) -> DataFrame:
    d = F.dayofmonth("trade_date")
    return bars.select(
        "dataset_id", "exchange", "ticker", "vendor_symbol", "currency", "trade_date",
        F.when(d == FAULT_DAYS["negative_open"], -F.col("open")).otherwise(F.col("open")).alias("open"),
        "high",
        F.when(d == FAULT_DAYS["low_above_high"], F.col("high") + 1).otherwise(F.col("low")).alias("low"),
        F.when(d == FAULT_DAYS["close_null"], F.lit(None)).otherwise(F.col("close")).alias("close"),
        F.when(d == FAULT_DAYS["negative_volume"], -F.col("volume"))
         .when(d == FAULT_DAYS["zero_volume"], F.lit(0).cast("bigint"))
         .otherwise(F.col("volume")).alias("volume"),
        F.when(d == FAULT_DAYS["adj_close_null"], F.lit(None)).otherwise(F.col("adj_close")).alias("adj_close"),
    )


# Re-deliveries: every tenth quantity again unchanged, an hour later; every eleventh with a price that differs in the last bits.
REDELIVERED, NEAR_PRICE, NEAR_FACTOR = 10, 11, 1.0 + 2.0 ** -50


def redelivered(ingest_rows: DataFrame) -> DataFrame:
    """``ingests`` with true re-deliveries (to be dropped) and near-equal ones (to be kept)."""
    later = F.col("ingest_ts") + F.expr("INTERVAL '1' HOUR")
    again = ingest_rows.where(F.col("q") % REDELIVERED == 0).withColumn("ingest_ts", later)
    near = ingest_rows.where(F.col("q") % NEAR_PRICE == 0).withColumn("ingest_ts", later).withColumn("px", F.col("px") * NEAR_FACTOR)
    # the first delivery twice over, byte for byte
    twice = ingest_rows.where(F.col("q") % REDELIVERED == 0)
    return ingest_rows.unionByName(again).unionByName(near).unionByName(twice)


OBJECT_EPOCH = 1_704_067_200  # 2024-01-01 UTC


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text objects from ``documents``: key, length in bytes, modification time, content."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("heartbeat/"), F.coalesce("source", F.lit("none")), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("key"),
        F.octet_length("text").cast("bigint").alias("length"),
        F.timestamp_seconds(F.lit(OBJECT_EPOCH) + F.col("doc_id") * 37 % 86_400).alias("modified"),
        F.col("text").alias("content"))


# Documents as dated text objects: so many dates, and so many documents of a date in one object at most.
OBJECT_DAYS, OBJECT_DOCS = 28, 500


def dated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_date, slice, doc_id, value: each document as a line (or several) of the object of its date and slice."""
    d = read_table(spark, sf_dir, "documents")
    number = F.pmod("doc_id", F.lit(OBJECT_DAYS)).cast("int")
    return d.select(F.date_add(F.lit("2024-01-01").cast("date"), number).alias("trade_date"), F.floor(F.col("doc_id") / (OBJECT_DAYS * OBJECT_DOCS)).alias("slice"),
                    "doc_id", F.col("text").alias("value"), number.alias("day_number"))


# Faults in vendor text: one order key in so many has a date or a price that does not parse.
BAD_DATE_EVERY, BAD_PRICE_EVERY = 997, 991


def vendor_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a vendor's text download per customer, with dates and prices that do not parse."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").cast("string").alias("ticker"),
        F.when(F.col("o_orderkey") % BAD_DATE_EVERY == 0, F.lit("no date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("Date"),
        F.when(F.col("o_orderkey") % BAD_PRICE_EVERY == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("Close"))

"""Dataset registry: declared schemas, business keys and object layout.

One ``DatasetSpec`` describes a tabular dataset of the lake; every operator
takes the spec (or uses ``OHLCV_DAILY``) instead of hard-coding names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the source system's for identical results.
# ---------------------------------------------------------------------------
DATASET_ID = "market_ohlcv_daily"
EXCHANGE = "ASX"
CURRENCY = "AUD"
VENDOR_SUFFIX = ".AX"
LOCAL_TZ = "Australia/Melbourne"
LOCAL_TZ_ABBREVIATIONS = {"daylight": "AEDT", "standard": "AEST"}
HEARTBEAT_PREFIX = "heartbeat/"
HEARTBEAT_KEY_FORMAT = "heartbeat/airflow_time_{stamp}.txt"  # stamp = yyyyMMdd_HHmmss local time
ROLLING_TRADING_DAYS = 30
DAILY_FETCH_CALENDAR_DAYS = 45
BACKFILL_CALENDAR_DAYS = 365 * 5
SNAPSHOT_DAYS_BACK_DEFAULT = 45
MIN_OBS_FRACTION = 0.8
ANOMALY_Z = 6.0
HIST_BINS = 80
DESCRIBE_PERCENTILES = (0.01, 0.05, 0.5, 0.95, 0.99)
REQUIRED_COLUMNS = (
    "dataset_id", "exchange", "ticker", "vendor_symbol", "currency", "trade_date",
    "open", "high", "low", "close", "volume", "adj_close",
    "ingest_ts", "ingest_batch_id", "source_object_key", "row_hash",
)
ROW_HASH_FIELDS = (
    "dataset_id", "exchange", "ticker", "trade_date",
    "open", "high", "low", "close", "volume", "currency",
)
STATE_VERSION = 1
PRICE_COLUMNS = ("open", "high", "low", "close", "adj_close")
MEASURE_COLUMNS = ("open", "high", "low", "close", "volume", "adj_close")
# ---------------------------------------------------------------------------

RAW_BAR_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.StringType(), False),
    T.StructField("exchange", T.StringType(), False),
    T.StructField("ticker", T.StringType(), False),
    T.StructField("vendor_symbol", T.StringType(), False),
    T.StructField("currency", T.StringType(), False),
    T.StructField("trade_date", T.DateType(), False),
    T.StructField("open", T.DoubleType(), True),
    T.StructField("high", T.DoubleType(), True),
    T.StructField("low", T.DoubleType(), True),
    T.StructField("close", T.DoubleType(), True),
    T.StructField("volume", T.LongType(), True),
    # Daily files have 11 columns, backfill files 12: adj_close must stay last.
    T.StructField("adj_close", T.DoubleType(), True),
])

LINEAGE_FIELDS = [
    T.StructField("ingest_ts", T.TimestampType(), True),
    T.StructField("ingest_batch_id", T.StringType(), True),
    T.StructField("source_object_key", T.StringType(), True),
    T.StructField("row_hash", T.StringType(), True),
]

CONFORMED_SCHEMA = T.StructType(RAW_BAR_SCHEMA.fields + LINEAGE_FIELDS)

TICKER_STATE_SCHEMA = T.StructType([
    T.StructField("status", T.StringType(), True),
    T.StructField("rows_written", T.LongType(), True),
    T.StructField("completed_at", T.TimestampType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("failed_at", T.TimestampType(), True),
])

STATE_DOC_SCHEMA = T.StructType([
    T.StructField("version", T.IntegerType(), True),
    T.StructField("last_updated", T.TimestampType(), True),
    T.StructField("window", T.StructType([
        T.StructField("start", T.DateType(), True),
        T.StructField("end", T.DateType(), True),
    ]), True),
    T.StructField("tickers", T.MapType(T.StringType(), TICKER_STATE_SCHEMA), True),
])

AUDIT_ERROR_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType(), True),
    T.StructField("vendor_symbol", T.StringType(), True),
    T.StructField("window_start", T.DateType(), True),
    T.StructField("window_end", T.DateType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("ts", T.TimestampType(), True),
])


@dataclass(frozen=True)
class DatasetSpec:
    """What the operators need to know of a dataset: its columns' roles and declared schemas.

    ``business_key`` starts with ``dataset_id``; an object of the raw zone is one
    business key, and its folders are the ``partition_columns``.
    """
    dataset_id: str = DATASET_ID
    exchange: str = EXCHANGE
    currency: str = CURRENCY
    vendor_suffix: str = VENDOR_SUFFIX
    business_key: tuple = ("dataset_id", "exchange", "ticker", "trade_date")
    analysis_key: tuple = ("exchange", "ticker", "trade_date")
    series_key: tuple = ("exchange", "ticker")
    date_column: str = "trade_date"
    partition_columns: tuple = ("exchange", "trade_date")
    hash_fields: tuple = ROW_HASH_FIELDS
    raw_schema: T.StructType = field(default=RAW_BAR_SCHEMA)

    @property
    def conformed_schema(self) -> T.StructType:
        return T.StructType(self.raw_schema.fields + LINEAGE_FIELDS)

    @property
    def object_columns(self) -> tuple:
        """Columns that tell the objects of one folder apart."""
        return tuple(c for c in self.business_key if c != "dataset_id" and c not in self.partition_columns)

    @property
    def partition_types(self) -> dict[str, str]:
        return {c: self.raw_schema[c].dataType.simpleString() for c in self.partition_columns}

    def prefix(self) -> str:
        return f"tabular/{self.dataset_id}/exchange={self.exchange}/"


OHLCV_DAILY = DatasetSpec()

#: Single events by type and day: a dataset of other keys, folders and measures.
USER_EVENTS = DatasetSpec(
    dataset_id="user_events",
    business_key=("dataset_id", "event_type", "event_date", "event_id"),
    analysis_key=("event_type", "event_date", "event_id"),
    series_key=("event_type", "user_id"),
    date_column="event_date",
    partition_columns=("event_type", "event_date"),
    hash_fields=("dataset_id", "event_type", "event_date", "event_id", "user_id", "value"),
    raw_schema=T.StructType([
        T.StructField("dataset_id", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("event_date", T.DateType(), False),
        T.StructField("event_id", T.LongType(), False),
        T.StructField("user_id", T.LongType(), True),
        T.StructField("value", T.DoubleType(), True),
    ]))

DATASETS = {spec.dataset_id: spec for spec in (OHLCV_DAILY, USER_EVENTS)}


@dataclass(frozen=True)
class LakePaths:
    """Base folders of the three zones (any Hadoop-compatible URI)."""
    raw: str
    conformed: str
    curated: str

    @staticmethod
    def under(base: str) -> "LakePaths":
        base = base.rstrip("/")
        return LakePaths(f"{base}/raw", f"{base}/conformed", f"{base}/curated")

    def table(self, zone: str, spec: DatasetSpec = OHLCV_DAILY) -> str:
        return f"{getattr(self, zone)}/tabular/{spec.dataset_id}"

"""Intake: ticker universe and vendor-frame normalisation to the declared bar schema."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean_ticker, nan_to_null, vendor_symbol
from ..spec import OHLCV_DAILY, RAW_BAR_SCHEMA, DatasetSpec

DATE_ALIASES = ("date", "datetime", "index")


def ticker_universe(lines: DataFrame, text_col: str = "value", pos_col: str = "pos",
                    header_token: str = "TICKER") -> DataFrame:
    """Clean, de-duplicated ticker list in first-seen order.

    ``lines`` holds one candidate ticker per row with its position in the
    source.  The first position is dropped only when it normalises to the
    header token, so header-less lists keep their first ticker.  Output:
    ``ticker, pos`` (pos = first position of the ticker), one row per ticker.
    A min-aggregate keeps it distributed (partial aggregation per ticker).
    """
    cleaned = lines.select(clean_ticker(text_col).alias("ticker"), F.col(pos_col).alias("pos"))
    per_ticker = cleaned.where(F.col("ticker") != "").groupBy("ticker").agg(
        F.min("pos").alias("pos"), F.count(F.lit(1)).alias("_n"))
    # A header can only be the very first line; when the token also occurs
    # later as a real ticker, that later occurrence is kept.
    first_pos = lines.select(F.min(pos_col)).scalar()  # scalar subquery, stays lazy
    header_only = (F.col("ticker") == F.lit(header_token)) & (F.col("pos") == first_pos)
    second = (cleaned.where((F.col("ticker") == F.lit(header_token)) & (F.col("pos") != first_pos))
              .groupBy("ticker").agg(F.min("pos").alias("pos2")))
    return (per_ticker.join(second, "ticker", "left")
            .select("ticker", F.when(header_only, F.col("pos2")).otherwise(F.col("pos")).alias("pos"))
            .where(F.col("pos").isNotNull()))


def _flat_lower(name: str) -> str:
    m = re.match(r"^\(\s*'([^']*)'", name)  # "('Close', 'BHP.AX')" -> "close"
    return (m.group(1) if m else name).strip().lower()


def standardise_columns(df: DataFrame) -> DataFrame:
    """Lower-case (and flatten tuple-style) column names; rename the date column to trade_date."""
    names = [_flat_lower(c) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate column names after standardising: {names}")
    out = df.toDF(*names)
    if "trade_date" not in names:
        for alias in DATE_ALIASES:
            if alias in names:
                out = out.withColumnRenamed(alias, "trade_date")
                break
        else:
            raise ValueError(f"Expected a date column (one of {DATE_ALIASES}); got columns={names}")
    return out


def _is_fractional(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("double", "float", "decimal")


def normalise_bars(vendor: DataFrame, ticker_col: str = "ticker",
                   spec: DatasetSpec = OHLCV_DAILY) -> DataFrame:
    """Vendor-shaped bars (Date/Open/High/Low/Close/[Adj Close]/Volume + ticker) -> raw bar rows.

    Casts never raise: unparsable dates, non-numeric text and NaN become null;
    integer volumes stay exact, others are truncated; the date keeps its day only.
    """
    df = standardise_columns(vendor)

    def num(c: str):
        if c not in df.columns:
            return F.lit(None).cast("double")
        return nan_to_null(F.col(c).try_cast("double"))

    adj = "adj close" if "adj close" in df.columns else "adj_close"
    vol = F.lit(None).cast("bigint")
    if "volume" in df.columns:
        vol = F.coalesce(F.col("volume").try_cast("bigint") if not _is_fractional(df, "volume") else F.lit(None).cast("bigint"), num("volume").try_cast("bigint"))
    day = F.col("trade_date") if df.schema["trade_date"].dataType.typeName() == "date" else F.col("trade_date").cast("string").try_cast("timestamp").cast("date")
    return df.select(
        F.lit(spec.dataset_id).alias("dataset_id"),
        F.lit(spec.exchange).alias("exchange"),
        F.col(ticker_col).cast("string").alias("ticker"),
        vendor_symbol(F.col(ticker_col).cast("string"), spec.vendor_suffix).alias("vendor_symbol"),
        F.lit(spec.currency).alias("currency"),
        day.alias("trade_date"),
        num("open").alias("open"), num("high").alias("high"),
        num("low").alias("low"), num("close").alias("close"),
        vol.alias("volume"),
        num(adj).alias("adj_close"),
    )


def vendor_faults(vendor: DataFrame, ticker_col: str = "ticker") -> DataFrame:
    """``ticker, error`` of the tickers with a date or number that does not parse (one aggregate)."""
    df = standardise_columns(vendor)
    bad = F.col("trade_date").isNull() | F.col("trade_date").cast("string").try_cast("timestamp").isNull()
    for c in ("open", "high", "low", "close", "adj close", "adj_close", "volume"):
        if c in df.columns:
            bad = bad | (F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull())
    counted = df.groupBy(F.col(ticker_col).cast("string").alias("ticker")).agg(F.count_if(bad).alias("_bad")).where("_bad > 0")
    return counted.select("ticker", F.concat(F.lit("Unparsable rows: "), F.col("_bad").cast("string")).alias("error"))


def typed_bars(df: DataFrame, schema: T.StructType = RAW_BAR_SCHEMA) -> DataFrame:
    """The columns of ``schema`` cast to their declared types; a value that does not parse raises (ANSI casts)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in df.columns])


def window_filter(df: DataFrame, as_of, days: int, date_col: str = "trade_date") -> DataFrame:
    """Rows with ``as_of - days <= date <= as_of`` (end day inclusive)."""
    as_of = F.lit(as_of).cast("date") if not hasattr(as_of, "_jc") else as_of
    return df.where(F.col(date_col).between(F.date_sub(as_of, days), as_of))


def last_n_bars(df: DataFrame, n: int, keys=("exchange", "ticker"), date_col: str = "trade_date") -> DataFrame:
    """The last ``n`` bars of each series.

    A per-series window: each series has at most one row per trade date
    (curated grain), so a partition is bounded by the calendar, not by data volume.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(F.col(date_col).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")

"""Price analytics: adjustment drift, daily returns, z-scores, anomalies, liquidity.

Per-series windows partition by (exchange, ticker) and order by trade_date:
a curated series has at most one bar per trade date, so each window
partition is bounded by the calendar, whatever the table size.  Both
windows (returns, z-score) share that partitioning: one shuffle.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import log10_positive, safe_ratio
from ..spec import ANOMALY_Z, OHLCV_DAILY


def adj_drift(df: DataFrame) -> DataFrame:
    """``adj_diff = adj_close - close`` and ``adj_diff_pct = adj_diff / close`` (null when close is 0)."""
    diff = F.col("adj_close") - F.col("close")
    return df.select("*", diff.alias("adj_diff"), safe_ratio(diff, F.col("close")).alias("adj_diff_pct"))


def daily_returns(df: DataFrame, price: str = "adj_close", fill: str = "pad",
                  keys: Sequence[str] = OHLCV_DAILY.series_key) -> DataFrame:
    """1-day simple return per series, ``ret_1d = p_t / p_{t-1} - 1``.

    ``fill="pad"`` carries the last valid price over nulls first (pandas 2
    ``pct_change``); ``fill="none"`` leaves gaps.  A zero previous price gives
    null instead of infinity.
    """
    w = Window.partitionBy(*keys).orderBy("trade_date")
    if fill == "pad":
        p = F.last(price, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    elif fill == "none":
        p = F.col(price)
    else:
        raise ValueError(f"unknown fill {fill!r}")
    with_p = df.withColumn("_p", p)
    return with_p.withColumn("ret_1d", safe_ratio(F.col("_p"), F.lag("_p").over(w)) - F.lit(1.0)).drop("_p")


def return_zscores(ret: DataFrame, keys: Sequence[str] = OHLCV_DAILY.series_key) -> DataFrame:
    """``ret_z = (ret - mean) / std_pop`` within the series; null for constant series."""
    w = Window.partitionBy(*keys)
    r = F.col("ret_1d")
    return ret.withColumn("ret_z", safe_ratio(r - F.avg(r).over(w), F.stddev_pop(r).over(w)))


def return_anomalies(z: DataFrame, threshold: float = ANOMALY_Z) -> DataFrame:
    return (z.where(F.abs("ret_z") >= F.lit(threshold))
            .select("exchange", "ticker", "trade_date", "adj_close", "ret_1d", "ret_z", "volume"))


def log_volume(df: DataFrame) -> DataFrame:
    return df.select("exchange", "ticker", "trade_date", "volume",
                     log10_positive("volume").alias("log10_volume"))


def top_coverage_series(df: DataFrame, keys: Sequence[str] = OHLCV_DAILY.series_key) -> DataFrame:
    """The series with the most rows (ties: smallest key)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("rows"), *[F.asc(k) for k in keys]).limit(1))


def series_for(df: DataFrame, exchange, ticker, value: str = "adj_close") -> DataFrame:
    """One series' non-null values by date (the data behind the price chart)."""
    return (df.where((F.col("exchange") == F.lit(exchange)) & (F.col("ticker") == F.lit(ticker)))
            .select("trade_date", value).where(F.col(value).isNotNull()))

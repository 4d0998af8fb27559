"""EDA report set: summary metrics/text and the CSV report sink.

All metrics are single-row aggregates over one typed bar table; they are
combined by a one-row equi-join on a constant key (broadcast), never a
driver-side loop.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import correlation, quality, returns
from ..session import stored
from ..spec import ANOMALY_Z, MIN_OBS_FRACTION

# Fixed summary line labels (the report text format).
SUMMARY_LABELS = (
    "Rows: ", "Tickers: ", "Date range: ", "Duplicate business keys (exchange,ticker,trade_date): ",
    "Rows failing OHLC bounds: ", "Rows with negative price: ", "Rows with negative volume: ",
    "Return anomalies (|z|>=6): ", "Correlation matrix tickers (>=80% obs): ",
)


#: Reports with one row per ticker, column or statistic; the others grow with the bars and keep their partitions.
SMALL_REPORTS = ("profile", "ticker_coverage", "nulls_overall", "nulls_by_ticker", "returns_describe", "median_volume_by_ticker")


def eda_metrics(bars: DataFrame, threshold: float = ANOMALY_Z, materialise: bool = True) -> DataFrame:
    """One row: rows, tickers, date range, duplicate keys, sanity counts, anomalies, return matrix shape, correlation size.

    The bar table feeds three plans (one global aggregate, the duplicate
    count, the per-series windows); it is materialised once in the shared
    folder (one row per ticker and day, bounded by universe x calendar) so
    they do not each recompute it.
    """
    if materialise:
        bars = stored(bars, "eda-bars")
    prof = bars.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("ticker").alias("tickers"),
                    F.min("trade_date").alias("date_min"), F.max("trade_date").alias("date_max"),
                    F.count_if(quality.negative_price()).alias("rows_with_negative_price"),
                    F.count_if(quality.negative_volume()).alias("rows_with_negative_volume"),
                    F.count_if(quality.ohlc_inversion()).alias("rows_failing_ohlc_bounds"))
    dups = quality.duplicate_counts(bars).select("duplicate_business_keys")
    z = stored(returns.return_zscores(returns.daily_returns(bars)).select("exchange", "ticker", "trade_date", "adj_close", "ret_1d", "ret_z", "volume"), "eda-returns")
    anoms = returns.return_anomalies(z, threshold).agg(F.count(F.lit(1)).alias("return_anomalies"))
    matrix = stored(correlation.return_matrix(z), "eda-matrix")
    shape = matrix.agg(F.countDistinct("trade_date").alias("matrix_dates"), F.countDistinct("ticker").alias("matrix_tickers"))
    corr_n = correlation.tickers_min_obs(matrix).agg(
        F.count(F.lit(1)).alias("correlation_tickers"))
    # one-row parts stacked and collapsed per column: no join between them
    parts = [prof, dups, anoms, shape, corr_n]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    cols = [c for p in parts for c in p.columns]
    return stacked.agg(*[F.max(c).alias(c) for c in cols])


def eda_summary(bars: DataFrame, threshold: float = ANOMALY_Z) -> DataFrame:
    """Metrics plus the nine human-readable summary lines joined by newlines (``summary``)."""
    m = eda_metrics(bars, threshold)
    n = lambda c: F.format_number(F.col(c), 0)  # noqa: E731  thousands separators
    lines = [
        F.concat(F.lit(SUMMARY_LABELS[0]), n("rows")),
        F.concat(F.lit(SUMMARY_LABELS[1]), n("tickers")),
        F.concat(F.lit(SUMMARY_LABELS[2]), F.date_format("date_min", "yyyy-MM-dd"), F.lit(" to "),
                 F.date_format("date_max", "yyyy-MM-dd")),
        F.concat(F.lit(SUMMARY_LABELS[3]), n("duplicate_business_keys")),
        F.concat(F.lit(SUMMARY_LABELS[4]), n("rows_failing_ohlc_bounds")),
        F.concat(F.lit(SUMMARY_LABELS[5]), n("rows_with_negative_price")),
        F.concat(F.lit(SUMMARY_LABELS[6]), n("rows_with_negative_volume")),
        F.concat(F.lit(SUMMARY_LABELS[7]), n("return_anomalies")),
        F.concat(F.lit(SUMMARY_LABELS[8]), n("correlation_tickers")),
    ]
    return m.select("*", F.concat_ws("\n", *lines).alias("summary"))


#: Times keep their microseconds in the files.
CSV_TIMESTAMPS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
REPORT_MANIFEST = "name string, rows long, file_schema string"


def _read_report(spark: SparkSession, out_dir: str, name: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("timestampFormat", CSV_TIMESTAMPS)
    return reader.csv(f"{out_dir.rstrip('/')}/{name}")


def write_reports(out_dir: str, tables: dict[str, DataFrame], small: tuple[str, ...] = ()) -> None:
    """Write each report table as header CSV under ``out_dir/<name>``, and a manifest of names, rows and schemas.

    Tables named in ``small`` are bounded (one row per ticker or statistic)
    and written as a single file, in their order; the rest keep their
    partitioning.  The manifest is written last: a report set without one is
    not finished.
    """
    entries = []
    for name, df in tables.items():
        w = (df.coalesce(1) if name in small else df).write.mode("overwrite").option("header", True)
        w.option("timestampFormat", CSV_TIMESTAMPS).csv(f"{out_dir.rstrip('/')}/{name}")
        entries.append((name, _read_report(df.sparkSession, out_dir, name, df.schema).count(), df.schema.json()))
    if entries:
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame(entries, REPORT_MANIFEST).coalesce(1).write.mode("overwrite").json(f"{out_dir.rstrip('/')}/manifest")


def read_reports(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The reports of a finished set by name, with the schemas of its manifest; raises if one has lost or gained rows."""
    out = {}
    for entry in spark.read.schema(REPORT_MANIFEST).json(f"{out_dir.rstrip('/')}/manifest").collect():
        df = _read_report(spark, out_dir, entry["name"], T.StructType.fromJson(json.loads(entry["file_schema"])))
        if (rows := df.count()) != entry["rows"]:
            raise RuntimeError(f"report {entry['name']} has {rows} rows, not {entry['rows']}")
        out[entry["name"]] = df
    return out


def write_summary_text(summary: DataFrame, out_dir: str) -> None:
    summary.select("summary").coalesce(1).write.mode("overwrite").text(f"{out_dir.rstrip('/')}/eda_summary")


def run_eda(bars: DataFrame, out_dir: str, threshold: float = ANOMALY_Z) -> dict[str, DataFrame]:
    """The full EDA report set over one curated bar table, written under ``out_dir``.

    The bar table and its returns are materialised once in the shared folder
    and feed every report; per-ticker and per-statistic reports are bounded
    and written as single sorted files, the correlation pairs keep their
    partitioning.  Returns the report DataFrames by name.
    """
    from ..operators import stats
    bars = stored(bars, "eda-bars")
    z = stored(returns.return_zscores(returns.daily_returns(bars)), "eda-returns")
    key = ["exchange", "ticker"]
    median = stats.exact_quantiles(bars, "volume", [0.5], key).select(*key, F.col("quantile").alias("median_volume"))
    tables = {
        "profile": quality.table_profile(bars),
        "ticker_coverage": quality.ticker_coverage(bars).orderBy(*key),
        "nulls_overall": quality.null_rates(bars).orderBy(F.desc("null_count"), "column_name"),
        "nulls_by_ticker": quality.null_rates_by_ticker(bars).orderBy(F.desc("close"), "ticker"),
        "returns_describe": stats.describe(z, "ret_1d"),
        "return_anomalies_z6": returns.return_anomalies(z, threshold).orderBy("ret_z", *key, "trade_date"),
        "median_volume_by_ticker": median.orderBy(F.desc("median_volume"), *key),
        "returns_correlation": correlation.return_correlation(
            correlation.return_matrix(z), min_obs_fraction=MIN_OBS_FRACTION, materialise=True),
    }
    write_reports(out_dir, tables, small=SMALL_REPORTS)
    write_summary_text(eda_summary(bars, threshold), out_dir)
    return tables

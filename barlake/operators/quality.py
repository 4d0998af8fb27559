"""Data-quality tables over curated bars: contract, profile, duplicates, nulls, coverage, sanity."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import business_days_between
from ..session import stored
from ..spec import CONFORMED_SCHEMA, MEASURE_COLUMNS, OHLCV_DAILY, PRICE_COLUMNS, REQUIRED_COLUMNS


# --- contract ---------------------------------------------------------------

def contract_report(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS,
                    declared: T.StructType = CONFORMED_SCHEMA) -> DataFrame:
    """One row per required column: present?, declared type, non-null count, status.

    ``status`` is ``ok``, ``missing`` (absent), ``wrong_type`` (not the declared
    type) or ``all_null`` (present, no value).
    Non-null counts come from a single aggregate pass over the present columns.
    """
    spark: SparkSession = df.sparkSession
    present = [c for c in required if c in df.columns]
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in present]) if present else None
    meta = spark.createDataFrame(
        [(i, c, c in df.columns, df.schema[c].dataType.simpleString() if c in df.columns else None,
          declared[c].dataType.simpleString() if c in declared.names else None) for i, c in enumerate(required)],
        "position int, column_name string, present boolean, data_type string, declared_type string")
    if counts is None:
        nn = spark.createDataFrame([], "column_name string, non_null bigint")
    else:
        stack = ", ".join(f"'{c}', `{c}`" for c in present)
        nn = counts.selectExpr(f"stack({len(present)}, {stack}) AS (column_name, non_null)")
    out = meta.join(F.broadcast(nn), "column_name", "left")  # nn: one row per required column
    return out.select(
        "position", "column_name", "present", "data_type", "declared_type", "non_null",
        F.when(~F.col("present"), F.lit("missing"))
         .when(F.col("data_type") != F.col("declared_type"), F.lit("wrong_type"))
         .when(F.col("non_null") == 0, F.lit("all_null"))
         .otherwise(F.lit("ok")).alias("status"))


# --- profile & duplicates ---------------------------------------------------

def table_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """rows, cols, distinct exchanges/tickers, trade_date and ingest_ts range: one row.

    ``approx=True`` counts distinct values with HyperLogLog++ sketches
    (``approx_count_distinct``) instead of exact distinct aggregation.
    """
    distinct = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.countDistinct(c))
    aggs = [F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("cols"),
            distinct("exchange").alias("exchanges"), distinct("ticker").alias("tickers"),
            F.min("trade_date").alias("date_min"), F.max("trade_date").alias("date_max")]
    if "ingest_ts" in df.columns:
        aggs += [F.min("ingest_ts").alias("ingest_ts_min"), F.max("ingest_ts").alias("ingest_ts_max")]
    return df.agg(*aggs)


def duplicate_counts(df: DataFrame, key: Sequence[str] = OHLCV_DAILY.analysis_key) -> DataFrame:
    """duplicate_business_keys = rows - distinct keys; duplicate_full_rows = rows - distinct rows.

    Nulls compare equal (grouping semantics).  One chain of two partial
    aggregations: full rows -> per key -> total; no join.
    """
    full = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    per_key = full.groupBy(*key).agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_distinct_rows"))
    return per_key.agg(
        (F.sum("_rows") - F.count(F.lit(1))).cast("bigint").alias("duplicate_business_keys"),
        (F.sum("_rows") - F.sum("_distinct_rows")).cast("bigint").alias("duplicate_full_rows"))


def duplicate_rows(df: DataFrame, key: Sequence[str] = OHLCV_DAILY.analysis_key, order: Sequence[str] | None = None) -> DataFrame:
    """All rows whose key occurs more than once, with ``key_rows`` = occurrences of the key and ``first_kept``.

    ``first_kept`` marks one row of each key, the least by ``order`` (all
    comparable columns by default); of rows that are equal in these, the one that
    comes first in the stored input.  The input is written once: its file and row
    number are each row's stable identity.  Keys are counted and their first rows
    found by one aggregate combined on the map side, and joined back (null-safe);
    there is no window over a key, so a hot key is never sorted in one task.
    """
    rows = stored(df, "duplicate-rows").select("*", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_identity"))
    order = list(order) if order is not None else [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    place = F.struct(*[F.col(c) for c in order], "_identity")
    found = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("key_rows"), F.min_by("_identity", place).alias("_first")).where(F.col("key_rows") > 1)
    found = found.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)], "key_rows", "_first")
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(key)]
    return rows.join(found, same, "inner").select(*df.columns, "key_rows", (F.col("_identity") == F.col("_first")).alias("first_kept"))


# --- nulls ------------------------------------------------------------------

def null_rates(df: DataFrame) -> DataFrame:
    """``column_name, null_count, null_rate`` for every column (one aggregate pass, then unpivot)."""
    cols = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("_rows"),
                    *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', _n{i}" for i, c in enumerate(cols))
    long = counts.selectExpr("_rows", f"stack({len(cols)}, {stack}) AS (column_name, null_count)")
    return long.select("column_name", "null_count",
                       F.try_divide(F.col("null_count"), F.col("_rows")).alias("null_rate"))


def null_rates_by_ticker(df: DataFrame, measures: Sequence[str] = MEASURE_COLUMNS,
                         key: str = "ticker") -> DataFrame:
    """Per ticker, fraction of null values of each measure."""
    return df.groupBy(key).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in measures])


# --- calendar coverage ------------------------------------------------------

def ticker_coverage(df: DataFrame, keys: Sequence[str] = OHLCV_DAILY.series_key) -> DataFrame:
    """rows, start, end, expected Mon-Fri days in [start, end] and ``missing_bdays``.

    ``missing_bdays = expected_bdays - rows``: duplicates and weekend rows make
    it smaller, even negative, exactly like the notebook diagnostic.
    """
    cov = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"),
                                F.min("trade_date").alias("start"), F.max("trade_date").alias("end"))
    exp = business_days_between("start", "end")
    return cov.select(*keys, "rows", "start", "end", exp.alias("expected_bdays"),
                      (exp - F.col("rows")).alias("missing_bdays"))


def worst_coverage(coverage: DataFrame, k: int = 20, keys: Sequence[str] = OHLCV_DAILY.series_key) -> DataFrame:
    """Top-k series by most missing business days, fewest rows first on ties."""
    return coverage.orderBy(F.desc("missing_bdays"), F.asc("rows"), *[F.asc(c) for c in keys]).limit(k)


def missing_business_days(df: DataFrame, keys: Sequence[str] = OHLCV_DAILY.series_key) -> DataFrame:
    """Every expected Mon-Fri date without a bar, for all series.

    One aggregate collects a series' distinct dates (at most one per day of
    its span, combined before the shuffle); the expected calendar is generated
    from the first and last of them, and the difference is exploded.
    """
    seen = df.groupBy(*keys).agg(F.collect_set("trade_date").alias("_seen"), F.min("trade_date").alias("_start"), F.max("trade_date").alias("_end"))
    expected = F.filter(F.sequence("_start", "_end"), lambda d: F.weekday(d) < 5)
    return seen.where("_start is not null").select(*keys, F.explode(F.array_except(expected, F.col("_seen"))).alias("trade_date"))


# --- OHLCV sanity -----------------------------------------------------------

def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def negative_price(prices: Sequence[str] = PRICE_COLUMNS) -> Column:
    cond = F.lit(False)
    for c in prices:
        cond = cond | _false_if_null(F.col(c) < 0)
    return cond


def negative_volume() -> Column:
    return _false_if_null(F.col("volume") < 0)


def ohlc_inversion() -> Column:
    lo_oc = F.least("open", "close")      # skips nulls like a row-wise min
    hi_oc = F.greatest("open", "close")
    return (_false_if_null(F.col("low") > lo_oc) | _false_if_null(F.col("high") < hi_oc) |
            _false_if_null(F.col("low") > F.col("high")))


def ohlc_check_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(negative_price()).alias("rows_with_negative_price"),
                  F.count_if(negative_volume()).alias("rows_with_negative_volume"),
                  F.count_if(ohlc_inversion()).alias("rows_failing_ohlc_bounds"))


def ohlc_violations(df: DataFrame) -> DataFrame:
    """Rows failing any sanity rule, with one flag per rule."""
    return df.select("*", negative_price().alias("negative_price"), negative_volume().alias("negative_volume"),
                     ohlc_inversion().alias("ohlc_inversion")) \
             .where(F.col("negative_price") | F.col("negative_volume") | F.col("ohlc_inversion"))

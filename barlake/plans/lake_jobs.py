"""The lake's scheduled jobs as batch functions over zone paths.

Each job composes the operators into one Spark plan per run (no per-ticker
or per-date driver loop) and is safe to re-run: raw is append-only (the
latest landed version of a bar is current), conformed is append-only behind
a file log and an anti join, curated dates are replaced by dynamic partition
overwrite, state and audit are appended once per run.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import control, curate, normalise
from ..session import stored
from ..sources.files import read_zone, write_raw_csv
from ..sources.listing import list_partitions
from ..spec import (BACKFILL_CALENDAR_DAYS, DAILY_FETCH_CALENDAR_DAYS, OHLCV_DAILY,
                    ROLLING_TRADING_DAYS, DatasetSpec, LakePaths)
from ..streaming import jobs


def ingest_daily(vendor: DataFrame, paths: LakePaths, as_of, rolling_days: int = ROLLING_TRADING_DAYS,
                 fetch_days: int = DAILY_FETCH_CALENDAR_DAYS) -> DataFrame:
    """Daily bars -> raw zone: the fetch window, normalised, last ``rolling_days`` bars per ticker.

    ``vendor`` is the landed download of all tickers (``ticker`` column plus
    vendor columns).  Returns the rows written.
    """
    bars = normalise.normalise_bars(vendor)
    bars = normalise.window_filter(bars, as_of, fetch_days)
    bars = normalise.last_n_bars(bars, rolling_days).drop("adj_close")  # daily files carry 11 columns
    write_raw_csv(bars, paths.table("raw"))
    return bars


def backfill(universe: DataFrame, vendor: DataFrame, paths: LakePaths, state_path: str, audit_path: str,
             as_of, run_ts: dt.datetime, days: int = BACKFILL_CALENDAR_DAYS) -> DataFrame:
    """Resumable backfill: pending tickers only; raw rows, state and audit are each appended once.

    A ticker with rows that do not parse is an error record of its own and
    lands nothing; all other tickers go on.  The state is written last, so a
    run that broke off is simply repeated.  Returns this run's outcome.
    """
    spark = universe.sparkSession
    pending = control.pending_tickers(universe, control.load_state(spark, state_path))
    wanted = stored(vendor.join(pending.select("ticker"), "ticker", "left_semi"), "backfill-vendor")
    faults = normalise.vendor_faults(wanted)
    start, end = control.backfill_window(as_of, days)
    bars = normalise.normalise_bars(wanted.join(faults.select("ticker"), "ticker", "left_anti"))
    bars = bars.where(F.col("trade_date").between(start, end))
    outcome = stored(control.run_backfill(pending, bars.select("ticker", "trade_date"), as_of, run_ts, days, faults=faults), "backfill-outcome")
    write_raw_csv(bars, paths.table("raw"))
    control.append_audit(control.audit_errors(outcome, as_of, run_ts, days), audit_path)
    control.append_state(control.state_rows(outcome, as_of, run_ts, days), state_path)
    return outcome


def promote_raw(spark: SparkSession, paths: LakePaths, ingest_ts: dt.datetime, batch_id: str | None = None,
                mode: str = "by_key", spec: DatasetSpec = OHLCV_DAILY) -> DataFrame:
    """Raw CSV -> conformed Parquet for objects not promoted yet; returns the new rows.

    One run of the promotion stream: its checkpoint opens only files that no
    earlier run has seen.  ``by_key``: a logical object (ticker, trade date) is
    converted once, the first conversion wins; ``by_content``: a changed version
    (new row hash) is converted again, so restatements reach the curated zone.
    Records that do not parse go to the zone's quarantine folder.
    """
    conformed, new, schema = paths.table("conformed", spec), [], spec.conformed_schema
    jobs.raw_to_conformed(spark, paths.table("raw", spec), conformed, f"{conformed}_checkpoint", ingest_ts, batch_id, mode, spec,
                          quarantine=f"{conformed}_quarantine", promoted=new)
    out = spark.createDataFrame([], schema)
    for rows in new:
        out = out.unionByName(rows.select(*schema.fieldNames()))
    return out


def refresh_snapshots(spark: SparkSession, paths: LakePaths, days_back: int | None = None, as_of=None, spec: DatasetSpec = OHLCV_DAILY) -> list:
    """Rebuild curated snapshots of stale partitions, such as (exchange, date), only (conformed newer than snapshot, or none).

    The stale list (one entry per exchange and trade date) drives partition
    pruning of the conformed read and the dynamic overwrite of the curated
    zone.  ``days_back`` is the number of dates up to and including ``as_of``.
    """
    conf_base, cur_base = paths.table("conformed", spec), paths.table("curated", spec)
    keys = list(spec.partition_columns)
    stale = curate.stale_partitions(_freshness(spark, conf_base, spec), _freshness(spark, cur_base, spec), keys)
    if days_back is not None:
        stale = normalise.window_filter(stale, as_of, days_back - 1, spec.date_column)
    pairs = sorted(tuple(r) for r in stale.select(*keys).collect())
    if pairs:
        curate.build_snapshots(read_zone(spark, conf_base, spec.conformed_schema, pairs, keys), cur_base, spec.business_key, keys)
    return pairs


def _freshness(spark: SparkSession, base: str, spec: DatasetSpec) -> DataFrame:
    """Newest modification per partition of a zone; no rows if the zone does not exist."""
    return curate.partition_freshness(list_partitions(spark, base, spec.partition_types, glob="*.parquet"), spec.partition_columns)


__all__ = ["ingest_daily", "backfill", "promote_raw", "refresh_snapshots", "OHLCV_DAILY"]

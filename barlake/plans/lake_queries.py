"""Registered queries that land data in fresh zones below the shared scratch folder and read it back.

Each one writes what the driver tables give, runs the operators as a scheduled
job would (listings, state log, replays), and returns what the zones then hold.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import coerce_timestamp
from ..operators import control, curate, promote
from ..operators.membership import SNAPSHOT_DATE, membership_intervals, read_universe, write_universe
from ..operators.normalise import ticker_universe
from ..operators.positions import with_positions
from ..operators.sketches import DISTINCT_ERROR, RANK_ERROR, daily_sketches, merged_profile
from ..operators.wide import export_wide, matrix_shape, read_long
from ..session import scratch_path, stored
from ..sources import adaptors
from ..sources.files import list_objects, overwrite_raw_objects, read_raw_csv, read_ticker_lines, read_zone, require_objects, write_raw_csv
from ..sources.listing import footprint, list_partitions, object_folder, write_text_objects
from ..sources.tables import read_table
from ..spec import CONFORMED_SCHEMA, RAW_BAR_SCHEMA, USER_EVENTS, LakePaths
from ..streaming import jobs
from . import catalog, frames, lake_jobs, reports

OBJECT_FOLDERS = {"trade_date": "date", "slice": "long"}


def _land_texts(spark: SparkSession, sf: str, path: str, days=None) -> None:
    """The documents as text objects, one per (trade_date, slice); ``days`` is a condition on ``day_number``."""
    texts = adaptors.dated_texts(spark, sf)
    texts = texts if days is None else texts.where(days)
    write_text_objects(texts, path, list(OBJECT_FOLDERS), ["doc_id", "value"])


# --- listings -------------------------------------------------------------------

def q_object_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Keys and sizes of the text objects, from a listing (raises if there is none)."""
    path = scratch_path(spark, "texts")
    _land_texts(spark, sf, path)
    listing = require_objects(list_partitions(spark, path, OBJECT_FOLDERS, glob="*.txt"), "the object listing")
    return listing.select(object_folder(F.col("key")).alias("key"), "trade_date", "slice", "length")


def q_storage_footprint(spark: SparkSession, sf: str) -> DataFrame:
    """Objects and bytes per date of the text objects, from a listing."""
    path = scratch_path(spark, "texts")
    _land_texts(spark, sf, path)
    return footprint(list_partitions(spark, path, OBJECT_FOLDERS, glob="*.txt"), ["trade_date"])


#: Every third date has a snapshot; then every second date gets newer objects.
SNAPSHOT_EVERY, RELANDED_EVERY = 3, 2


def q_listing_stale_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Dates whose conformed objects are newer than their snapshot, or that have none, from two listings."""
    conformed, curated = scratch_path(spark, "conformed-texts"), scratch_path(spark, "curated-texts")
    _land_texts(spark, sf, conformed)
    _land_texts(spark, sf, curated, F.col("day_number") % SNAPSHOT_EVERY == 0)
    _land_texts(spark, sf, conformed, F.col("day_number") % RELANDED_EVERY == 0)
    zones = [curate.partition_freshness(list_partitions(spark, p, OBJECT_FOLDERS, glob="*.txt")) for p in (conformed, curated)]
    return curate.stale_partitions(*zones).select("trade_date", F.col("snapshot_modified").isNotNull().alias("has_snapshot"))


# --- promotion --------------------------------------------------------------------

def _source_bars(spark: SparkSession, sf: str) -> DataFrame:
    """The bars that all deliveries are made of, aggregated once."""
    return stored(frames.user_bars(spark, sf).select(*RAW_BAR_SCHEMA.fieldNames()), "deliveries")


def _deliveries(bars: DataFrame) -> list[DataFrame]:
    """Three deliveries of bars: the even days; all days, some with other prices; all days as they were first."""
    day = F.dayofmonth("trade_date")
    restated = F.when(day % RESTATED_DAY == 0, F.col("close") + RESTATED_BY).otherwise(F.col("close"))
    return [bars.where(day % 2 == 0), bars.withColumn("close", restated), bars]


RESTATED_DAY, RESTATED_BY = 7, 1.5
DELIVERIES = ("first", "second", "third")


def _promote_deliveries(spark: SparkSession, source: DataFrame, paths: LakePaths, mode: str, refresh: bool = False) -> None:
    """Deliver, promote (the first by the stream itself, the others by batch runs into the same zone) and refresh."""
    for number, (batch_id, bars) in enumerate(zip(DELIVERIES, _deliveries(source), strict=True)):
        write_raw_csv(bars, paths.table("raw"))
        stamp = frames.INGEST_TS + dt.timedelta(days=number)
        if number == 0:
            conformed = paths.table("conformed")
            jobs.raw_to_conformed(spark, paths.table("raw"), conformed, f"{conformed}_stream", stamp, batch_id, mode)
        else:
            lake_jobs.promote_raw(spark, paths, stamp, batch_id, mode)
        if refresh:
            lake_jobs.refresh_snapshots(spark, paths)


def q_promote_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The conformed zone after three deliveries, in both modes.

    Each mode keeps every object; ``by_content`` also the restated versions and
    the later ones that go back to the first value.
    """
    source, zones = _source_bars(spark, sf), []
    for mode in ("by_key", "by_content"):
        paths = LakePaths.under(scratch_path(spark, f"promote-{mode}"))
        _promote_deliveries(spark, source, paths, mode)
        zones.append(read_zone(spark, paths.table("conformed"), CONFORMED_SCHEMA).select(
            F.lit(mode).alias("mode"), "source_object_key", "ticker", "trade_date", "close", "ingest_batch_id", "ingest_ts"))
    return zones[0].unionByName(zones[1])


def q_restated_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The curated zone after three deliveries, refreshed after each from the zones' listings: restated bars are back at their first value."""
    paths = LakePaths.under(scratch_path(spark, "restated"))
    _promote_deliveries(spark, _source_bars(spark, sf), paths, "by_content", refresh=True)
    return read_zone(spark, paths.table("curated"), CONFORMED_SCHEMA).select("ticker", "trade_date", "close", "ingest_batch_id")


def q_copy_new_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Key-preserving promotion of (key, content): two deliveries, the second brings some objects again and is repeated."""
    sink = scratch_path(spark, "objects")
    objects = adaptors.objects(spark, sf)
    first = objects.where(F.col("length") % 3 == 0).withColumn("delivery", F.lit(1))
    promote.copy_new_objects(first, sink, batch=0)
    for _ in range(2):                                            # an attempt that has to be made again
        promote.copy_new_objects(objects.withColumn("delivery", F.lit(2)), sink, batch=1)
    return spark.read.parquet(sink).select("key", "content", "delivery")


def q_stream_copy_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Text objects of two landings copied by a keyed stream, then by another one without the first one's log."""
    base = scratch_path(spark, "copied-texts")
    for part in (0, 1):
        _land_texts(spark, sf, f"{base}/raw", F.col("day_number") % 2 == part)
        jobs.copy_objects(spark, f"{base}/raw", f"{base}/sink", f"{base}/_log", glob="*.txt")
    jobs.copy_objects(spark, f"{base}/raw", f"{base}/sink", f"{base}/_other_log", glob="*.txt")
    return spark.read.parquet(f"{base}/sink").select(object_folder(F.col("key")).alias("key"), F.octet_length("content").alias("length"), F.sha2("content", 256).alias("sha256"))


# --- state ---------------------------------------------------------------------------

def _retried(outcome: DataFrame, every: int, run_ts: dt.datetime, complete: bool) -> DataFrame:
    """A later run's records of the failed tickers whose number ``every`` divides."""
    ts = F.lit(run_ts).cast("timestamp")
    failed = outcome.where((F.col("status") == "error") & (F.col("ticker").cast("long") % every == 0)).select("ticker")
    if complete:
        return failed.select("ticker", F.lit("complete").alias("status"), F.lit(every).cast("long").alias("rows_written"), ts.alias("completed_at"),
                             F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp").alias("failed_at"))
    return failed.select("ticker", F.lit("error").alias("status"), F.lit(None).cast("long").alias("rows_written"), F.lit(None).cast("timestamp").alias("completed_at"),
                         F.lit("failed again").alias("error"), ts.alias("failed_at"))


def q_state_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """The state after three runs, with the first two folded into a snapshot and dropped from the log."""
    path = scratch_path(spark, "state")
    outcome = stored(catalog._outcome(spark, sf), "outcome")
    runs = [outcome, _retried(outcome, 2, frames.RUN_TS + dt.timedelta(days=1), True), _retried(outcome, 3, frames.RUN_TS + dt.timedelta(days=2), False)]
    for day, records in enumerate(runs):
        if day == 2:
            control.compact_state(spark, path)
            control.expire_state(spark, path)
        control.append_state(control.state_rows(records, frames.BACKFILL_AS_OF, frames.RUN_TS + dt.timedelta(days=day)), path)
    state = control.load_state(spark, path)
    return state.select("ticker", "status", "rows_written", "completed_at", "error", "failed_at", "last_updated")


def q_state_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The state written as whole JSON documents and read back."""
    path = scratch_path(spark, "state-docs")
    control.write_state_docs(stored(catalog._outcome(spark, sf), "outcome"), path, frames.BACKFILL_AS_OF, frames.RUN_TS, tickers_per_doc=500)
    return control.state_doc_table(control.read_state_doc(spark, path))


# --- raw objects --------------------------------------------------------------------

RAW_OBJECT = ("exchange", "trade_date", "ticker")
RELANDED_DAY, RELANDED_BY = 5, 2.5


def q_reland_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Bars landed as one raw object per ticker and date, some of them landed again: values, files and whether the files changed."""
    path = scratch_path(spark, "raw-objects")
    bars = stored(adaptors.bars_event_type(spark, sf).select(*RAW_BAR_SCHEMA.fieldNames()), "object-bars")
    overwrite_raw_objects(bars, path)
    before = stored(list_objects(spark, path, glob="*.csv").select(F.col("path").alias("_old")), "listing")
    again = bars.where((F.dayofmonth("trade_date") % RELANDED_DAY == 0) & (F.length("ticker") % 2 == 1))
    overwrite_raw_objects(again.withColumn("close", F.col("close") + RELANDED_BY), path)
    after = list_partitions(spark, path, {"exchange": "string", "trade_date": "date", "ticker": "string"}, glob="*.csv")
    files = after.join(before, F.col("path") == F.col("_old"), "left").groupBy(*RAW_OBJECT).agg(
        F.count(F.lit(1)).alias("files"), F.max(F.col("_old").isNull()).alias("relanded"))
    rows = read_raw_csv(spark, path, RAW_BAR_SCHEMA, RAW_OBJECT).select(*RAW_OBJECT, "close")
    return rows.join(files, list(RAW_OBJECT))


# --- global orders -----------------------------------------------------------------------

RANKED_Z = 2.0


def q_report_nulls_by_ticker(spark: SparkSession, sf: str) -> DataFrame:
    """The report's order (most missing closes first) as a position."""
    return with_positions(catalog.q_null_rates_by_ticker(spark, sf), [F.desc("close"), "ticker"])


def q_anomaly_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """All bars with |z| >= 2 in one global order, the most extreme first."""
    z = catalog.q_return_zscores(spark, sf).where(F.abs("ret_z") >= RANKED_Z)
    return with_positions(z, [F.desc(F.abs("ret_z")), "exchange", "ticker", "trade_date"])


# --- stored profiles and exports ------------------------------------------------------------

def q_sketch_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly profiles from stored daily sketches, each next to the exact figures: whether the estimates keep their bounds."""
    orders = read_table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_custkey", "o_totalprice")
    sketches = stored(daily_sketches(orders, "day", ["o_custkey"], ["o_totalprice"]), "sketches")
    merged = stored(merged_profile(sketches, [F.year("day").alias("year")], ["o_custkey"], ["o_totalprice"], (0.5, 0.99)), "profiles")
    price = F.col("o_totalprice")
    exact = orders.withColumn("year", F.year("day")).join(merged.select("year", "o_totalprice_p50", "o_totalprice_p99"), "year").groupBy("year").agg(
        F.countDistinct("o_custkey").alias("customers"),
        *[F.avg(compare.cast("double")).alias(f"_{name}_{p}") for p in ("p50", "p99")
          for name, compare in (("below", price < F.col(f"o_totalprice_{p}")), ("upto", price <= F.col(f"o_totalprice_{p}")))])
    near = F.abs(F.col("o_custkey_estimate") - F.col("customers")) <= DISTINCT_ERROR * F.col("customers")
    ranks = [((F.col(f"_below_{p}") <= q + RANK_ERROR) & (F.col(f"_upto_{p}") >= q - RANK_ERROR)).alias(f"{p}_within") for p, q in (("p50", 0.5), ("p99", 0.99))]
    return merged.join(exact, "year").select("year", "rows", "customers", near.alias("customers_within"), *ranks,
                                             F.col("o_totalprice_min").alias("least"), F.col("o_totalprice_max").alias("greatest"))


def q_wide_matrix_export(spark: SparkSession, sf: str) -> DataFrame:
    """The return matrix written as wide column blocks and read back as long rows, with the shape from the manifest."""
    path = scratch_path(spark, "wide")
    matrix = stored(frames.user_matrix(spark, sf), "matrix")
    shape = matrix_shape(export_wide(matrix, path, block_columns=64)).first()
    return read_long(spark, path).select("*", F.lit(shape["rows"]).alias("matrix_rows"), F.lit(shape["columns"]).alias("matrix_columns"))


def q_report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The report set written with its manifest and read back: rows of each report, and rows that differ (floats at report precision)."""
    out = scratch_path(spark, "reports")
    tables = reports.run_eda(frames.faulted(spark, sf), out)
    parts = []
    for name, back in reports.read_reports(spark, out).items():
        floats = [f.name for f in back.schema.fields if f.dataType.typeName() == "double"]
        there, here = catalog.rounded(back, floats), catalog.rounded(tables[name], floats)
        differ = here.exceptAll(there).select(F.lit(0).alias("_back")).unionByName(there.exceptAll(here).select(F.lit(0).alias("_back")))
        counted = back.select(F.lit(1).alias("_back")).unionByName(differ).agg(F.count_if(F.col("_back") == 1).alias("rows"), F.count_if(F.col("_back") == 0).alias("differing"))
        parts.append(counted.select(F.lit(name).alias("report"), "rows", "differing", F.lit(len(back.columns)).alias("columns")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- dated universe, other datasets, layouts --------------------------------------------------

def _half_years(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with orders in each half-year, dated by its end."""
    day = F.col("o_orderdate").cast("date")
    half = F.make_date(F.year(day), F.when(F.month(day) <= 6, 6).otherwise(12), F.lit(30))
    return read_table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("ticker"), half.alias(SNAPSHOT_DATE)).distinct()


def q_membership_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Spells of each ticker in the dated universe, read back from its snapshots."""
    path = scratch_path(spark, "universe")
    write_universe(_half_years(spark, sf), path)
    return membership_intervals(read_universe(spark, path))


UNIVERSE_AS_OF = "1998-03-01"


def q_universe_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """The universe that held on a date: the newest snapshot up to it."""
    path = scratch_path(spark, "universe")
    write_universe(_half_years(spark, sf), path)
    return read_universe(spark, path, UNIVERSE_AS_OF).select("ticker", SNAPSHOT_DATE)


EVENT_RESTATED, EVENT_RESTATED_BY = 5, 1.0


def q_events_raw_to_curated(spark: SparkSession, sf: str) -> DataFrame:
    """A second dataset through the lake by its spec alone: two deliveries of events, raw to curated."""
    paths = LakePaths.under(scratch_path(spark, "events-lake"))
    events = stored(adaptors.raw_events(spark, sf).select(*USER_EVENTS.raw_schema.fieldNames()), "raw-events")
    restated = F.when(F.col("event_id") % EVENT_RESTATED == 0, F.col("value") + EVENT_RESTATED_BY).otherwise(F.col("value"))
    for number, rows in enumerate((events.where(F.col("event_id") % 2 == 0), events.withColumn("value", restated))):
        write_raw_csv(rows, paths.table("raw", USER_EVENTS), USER_EVENTS.partition_columns)
        lake_jobs.promote_raw(spark, paths, frames.INGEST_TS + dt.timedelta(days=number), DELIVERIES[number], "by_content", USER_EVENTS)
        lake_jobs.refresh_snapshots(spark, paths, spec=USER_EVENTS)
    curated = read_zone(spark, paths.table("curated", USER_EVENTS), USER_EVENTS.conformed_schema)
    return curated.select("event_type", "event_date", "event_id", "user_id", "value", "source_object_key", "row_hash", "ingest_batch_id")


def q_raw_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """Landed files of 11 columns (daily, without ``adj_close``) and of 12 (backfill) read as one table."""
    path = scratch_path(spark, "landed")
    bars = stored(frames.user_bars(spark, sf).select(*RAW_BAR_SCHEMA.fieldNames()), "layout-bars")
    even = F.dayofmonth("trade_date") % 2 == 0
    bars.where(even).drop("adj_close").write.option("header", True).csv(f"{path}/daily")
    bars.where(~even).write.option("header", True).csv(f"{path}/backfill")
    return read_raw_csv(spark, path, landed=True)


def q_ticker_file(spark: SparkSession, sf: str) -> DataFrame:
    """Tickers of a written list whose other field is quoted and holds commas."""
    path = scratch_path(spark, "tickers")
    part = read_table(spark, sf, "part")
    line = F.to_csv(F.struct(F.concat(F.lit(" "), F.lower("p_brand"), F.lit(" ")).alias("ticker"), F.concat("p_brand", F.lit(', "listed", '), F.col("p_partkey").cast("string")).alias("name")))
    part.select(line.alias("value")).write.text(path)
    return ticker_universe(read_ticker_lines(spark, path)).select("ticker")


WINDOW_AS_OF, WINDOW_DATES = "2024-01-15", 10


def q_refresh_window(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per date of the curated zone after a refresh that looks back ten dates."""
    paths = LakePaths.under(scratch_path(spark, "window"))
    write_raw_csv(frames.user_bars(spark, sf).select(*RAW_BAR_SCHEMA.fieldNames()), paths.table("raw"))
    lake_jobs.promote_raw(spark, paths, frames.INGEST_TS, frames.BATCH_ID)
    lake_jobs.refresh_snapshots(spark, paths, days_back=WINDOW_DATES, as_of=WINDOW_AS_OF)
    return read_zone(spark, paths.table("curated"), CONFORMED_SCHEMA).groupBy("trade_date").agg(F.count(F.lit(1)).alias("rows"))


def q_coerced_ingest_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times from text in several ISO forms; what is none is null."""
    ev = read_table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    form = F.col("event_id") % 4
    text = (F.when(form == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(form == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
            .when(form == 2, F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL '10' HOUR"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+10:00"))).otherwise(F.concat(F.lit("run "), F.col("event_id").cast("string"))))
    return ev.select("event_id", coerce_timestamp(text).alias("ingest_ts"))


QUERIES = {
    "ticker_file": q_ticker_file,
    "refresh_window": q_refresh_window,
    "coerced_ingest_times": q_coerced_ingest_times,
    "sketch_profile": q_sketch_profile,
    "wide_matrix_export": q_wide_matrix_export,
    "report_round_trip": q_report_round_trip,
    "membership_intervals": q_membership_intervals,
    "universe_as_of": q_universe_as_of,
    "events_raw_to_curated": q_events_raw_to_curated,
    "raw_layouts": q_raw_layouts,
    "object_inventory": q_object_inventory,
    "storage_footprint": q_storage_footprint,
    "listing_stale_partitions": q_listing_stale_partitions,
    "promote_incremental": q_promote_incremental,
    "restated_snapshot": q_restated_snapshot,
    "copy_new_objects": q_copy_new_objects,
    "stream_copy_objects": q_stream_copy_objects,
    "state_compacted": q_state_compacted,
    "state_documents": q_state_documents,
    "reland_objects": q_reland_objects,
    "report_nulls_by_ticker": q_report_nulls_by_ticker,
    "anomaly_ranking": q_anomaly_ranking,
}

"""Backfill control plane as set operations: window, resumable state, pending list, error audit.

A backfill run over a universe is expressed as one plan: fetched rows are
counted per ticker; tickers with rows become ``complete`` state records,
tickers without rows become ``error`` records and audit entries.  The next
run's pending list is the universe minus completed tickers (an anti join),
so errors are retried and completed tickers are skipped.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import vendor_symbol
from ..spec import (AUDIT_ERROR_SCHEMA, BACKFILL_CALENDAR_DAYS, HEARTBEAT_KEY_FORMAT, STATE_VERSION, STATE_DOC_SCHEMA, TICKER_STATE_SCHEMA,
                    VENDOR_SUFFIX)

NO_DATA_ERROR = "No data returned"
#: Name of a run's folder in the state log; sorts by time.
STATE_RUN_FORMAT = "yyyyMMdd'T'HHmmssSSSSSS"


def backfill_window(as_of, days: int = BACKFILL_CALENDAR_DAYS, mode: str = "days") -> tuple[Column, Column]:
    """``(start, end)`` of the backfill window ending at ``as_of``.

    ``mode="days"``   start = as_of - days (fixed day count, default 1825);
    ``mode="years"``  start = as_of - 5 calendar years.
    """
    end = F.lit(as_of).cast("date")
    if mode == "days":
        start = F.date_sub(end, days)
    elif mode == "years":
        start = F.add_months(end, -60)
    else:
        raise ValueError(f"unknown window mode {mode!r}")
    return start, end


def run_backfill(universe: DataFrame, fetched: DataFrame, as_of, run_ts,
                 days: int = BACKFILL_CALENDAR_DAYS, faults: DataFrame | None = None) -> DataFrame:
    """Per-ticker outcome of one run: ``ticker, status, rows_written, completed_at, error, failed_at``.

    ``fetched`` holds the rows the vendor returned (``ticker, trade_date``);
    only rows inside the window count.  Counting is a grouped aggregate,
    joined to the universe by ticker.  A ticker listed in ``faults`` (``ticker,
    error``) failed with that error, whatever else it brought.
    """
    start, end = backfill_window(as_of, days)
    rows = (fetched.where(F.col("trade_date").between(start, end))
            .groupBy("ticker").agg(F.count(F.lit(1)).alias("rows_written")))
    ts = F.lit(run_ts).cast("timestamp")
    joined = universe.select("ticker").join(rows, "ticker", "left")
    if faults is None:
        joined = joined.withColumn("_fault", F.lit(None).cast("string"))
    else:
        joined = joined.join(faults.select("ticker", F.col("error").alias("_fault")), "ticker", "left")
    ok = (F.coalesce(F.col("rows_written"), F.lit(0)) > 0) & F.col("_fault").isNull()
    return joined.select(
        "ticker",
        F.when(ok, F.lit("complete")).otherwise(F.lit("error")).alias("status"),
        F.when(ok, F.col("rows_written")).alias("rows_written"),
        F.when(ok, ts).alias("completed_at"),
        F.when(~ok, F.coalesce("_fault", F.lit(NO_DATA_ERROR))).alias("error"),
        F.when(~ok, ts).alias("failed_at"),
    )


def audit_errors(outcome: DataFrame, as_of, run_ts, days: int = BACKFILL_CALENDAR_DAYS,
                 suffix: str = VENDOR_SUFFIX) -> DataFrame:
    """Audit entries for failed tickers, partitionable by ``run_date`` (append-only)."""
    start, end = backfill_window(as_of, days)
    return outcome.where(F.col("status") == "error").select(
        end.alias("run_date"), "ticker", vendor_symbol("ticker", suffix).alias("vendor_symbol"),
        start.alias("window_start"), end.alias("window_end"), "error",
        F.lit(run_ts).cast("timestamp").alias("ts"))


def merge_state(previous: DataFrame | None, outcome: DataFrame) -> DataFrame:
    """New state: this run's outcome overrides the previous record of the same ticker."""
    if previous is None:
        return outcome
    return previous.join(outcome.select("ticker"), "ticker", "left_anti").unionByName(outcome)


def pending_tickers(universe: DataFrame, state: DataFrame | None) -> DataFrame:
    """Universe tickers not yet ``complete`` (errors are retried)."""
    if state is None:
        return universe
    done = state.where(F.col("status") == "complete").select("ticker")
    return universe.join(done, "ticker", "left_anti")


def state_to_json(state: DataFrame) -> DataFrame:
    """One JSON line per ticker: ``{"ticker": {status record}}`` (a map entry of the state doc)."""
    rec = F.struct(*[F.col(f.name) for f in TICKER_STATE_SCHEMA.fields])
    return state.select(F.to_json(F.create_map(F.col("ticker"), rec)).alias("value"))


def state_from_json(lines: DataFrame, col: str = "value") -> DataFrame:
    """Parse map-entry JSON lines back to ``ticker`` + status record columns."""
    m = F.from_json(F.col(col), "map<string, struct<status:string, rows_written:bigint, "
                                "completed_at:timestamp, error:string, failed_at:timestamp>>")
    ex = lines.select(F.explode(m).alias("ticker", "rec"))
    return ex.select("ticker", *[F.col("rec." + f.name).alias(f.name) for f in TICKER_STATE_SCHEMA.fields])


def read_state_doc(spark, path: str) -> DataFrame:
    """A whole-document JSON state (``version, last_updated, window, tickers`` map), declared schema."""
    return spark.read.schema(STATE_DOC_SCHEMA).option("multiLine", True).json(path)


def state_doc_table(doc: DataFrame) -> DataFrame:
    """Explode a whole-document state (``version, last_updated, window, tickers map``) to rows."""
    return doc.select(F.explode("tickers").alias("ticker", "rec")).select(
        "ticker", *[F.col("rec." + f.name).alias(f.name) for f in TICKER_STATE_SCHEMA.fields])



def universe_snapshot(universe: DataFrame, snapshot_date) -> DataFrame:
    """Dated constituent list: the universe tagged with ``constituents_snapshot_date`` (partition column)."""
    return universe.select("*", F.lit(snapshot_date).cast("date").alias("constituents_snapshot_date"))


def heartbeat_time_from_key(key) -> Column:
    """Local wall-clock time encoded in a heartbeat key (``spec.HEARTBEAT_KEY_FORMAT``); null if absent."""
    import re
    head, tail = HEARTBEAT_KEY_FORMAT.split("{stamp}")
    pattern = re.escape(head.split("/")[-1]) + r"(\d{8}_\d{6})" + re.escape(tail) + "$"
    stamp = F.regexp_extract(key if isinstance(key, Column) else F.col(key), pattern, 1)
    return F.when(stamp != "", F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss")))


def retention_candidates(objects: DataFrame, as_of, keep_days: int, key: str = "key") -> DataFrame:
    """Heartbeat objects older than ``keep_days`` before ``as_of`` (the delete list; deletion is left
    to the operator).  Objects whose key carries no timestamp are never listed."""
    t = heartbeat_time_from_key(key)
    cutoff = F.date_sub(F.lit(as_of).cast("date"), keep_days)
    return objects.select("*", t.alias("object_time")).where(F.col("object_time") < cutoff.cast("timestamp"))


def state_rows(outcome: DataFrame, as_of, run_ts, days: int = BACKFILL_CALENDAR_DAYS,
               version: int = STATE_VERSION) -> DataFrame:
    """State records stamped with the document fields (version, last_updated, window)."""
    start, end = backfill_window(as_of, days)
    return outcome.select("*", F.lit(version).alias("version"),
                          F.lit(run_ts).cast("timestamp").alias("last_updated"),
                          start.alias("window_start"), end.alias("window_end"))


def _state_schema() -> T.StructType:
    return T.StructType([T.StructField("ticker", T.StringType()), *TICKER_STATE_SCHEMA.fields,
                         T.StructField("version", T.IntegerType()), T.StructField("last_updated", T.TimestampType()),
                         T.StructField("window_start", T.DateType()), T.StructField("window_end", T.DateType())])


def append_state(state: DataFrame, path: str) -> None:
    """Append one run's records (JSON lines, one per ticker) to the state log, as the folder of the run.

    The folder is named by ``last_updated``.  Nothing that other runs wrote is
    touched, so a run that breaks off in the middle leaves the state of the runs
    before it; a run that is repeated with its time replaces its own folder.
    """
    rows = state.withColumn("run", F.date_format("last_updated", STATE_RUN_FORMAT))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(path)


def _newest_records(runs: DataFrame) -> DataFrame:
    rest = [f.name for f in _state_schema().fields[1:]]
    newest = runs.groupBy("ticker").agg(F.max_by(F.struct(*rest), F.struct("last_updated", F.col("status") == "complete")).alias("_r"))
    return newest.select("ticker", *[F.col(f"_r.{c}").alias(c) for c in rest])


def _snapshot_mark(spark, path: str) -> str | None:
    """The run up to which the newest finished snapshot holds the log; one short row per compaction."""
    from ..sources.files import path_exists
    if not path_exists(spark, f"{path}_snapshots/marks"):
        return None
    return spark.read.schema("through string").json(f"{path}_snapshots/marks").agg(F.max("through")).first()[0]


def load_state(spark, path: str, through: str | None = None) -> DataFrame | None:
    """The newest record of each ticker, or ``None`` when no state was written yet.

    The newest snapshot is merged with the records of later runs only (the runs
    are folders, so earlier ones are not read).  A missing state means "start
    from scratch"; an unreadable one raises instead of silently restarting
    every ticker.  ``through`` leaves out runs after it.
    """
    from ..sources.files import path_exists
    mark = _snapshot_mark(spark, path)
    if mark is None and not path_exists(spark, path):
        return None
    schema = _state_schema()
    log = None
    if path_exists(spark, path):
        with_run = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
        log = spark.read.schema(with_run).option("mode", "FAILFAST").option("basePath", path).json(path)
        if mark is not None:
            log = log.where(F.col("run").isNull() | (F.col("run") > mark))
        if through is not None:
            log = log.where(F.col("run").isNull() | (F.col("run") <= through))
        log = log.drop("run")
    if mark is not None:
        snapshot = spark.read.schema(schema).parquet(f"{path}_snapshots/through={mark}")
        log = snapshot if log is None else snapshot.unionByName(log)
    return _newest_records(log)


def compact_state(spark, path: str) -> str | None:
    """Fold the log into a snapshot; returns the newest run it holds (the high-water mark), ``None`` without a log.

    Runs that are appended meanwhile stay in the log.  The snapshot counts once its
    mark is written, which is the last step, so a compaction that breaks off
    changes nothing; ``expire_state`` may then drop what it holds.
    """
    from ..sources.listing import list_partitions
    runs = list_partitions(spark, path, {"run": "string"}, glob="*.json")
    mark, before = runs.agg(F.max("run")).first()[0], _snapshot_mark(spark, path)
    if mark is None or (before is not None and mark <= before):
        return before
    load_state(spark, path, through=mark).write.mode("overwrite").parquet(f"{path}_snapshots/through={mark}")
    spark.createDataFrame([(mark,)], "through string").write.mode("append").json(f"{path}_snapshots/marks")
    return mark


def expire_state(spark, path: str) -> int:
    """Delete the log folders and snapshots that the newest snapshot replaces; returns how many."""
    from ..sources.files import delete_path
    from ..sources.listing import list_partitions
    mark = _snapshot_mark(spark, path)
    if mark is None:
        return 0
    runs = list_partitions(spark, path, {"run": "string"}, glob="*.json").where(F.col("run") <= mark).select("run").distinct()
    snapshots = list_partitions(spark, f"{path}_snapshots", {"through": "string"}, glob="*.parquet").where(F.col("through") < mark).select("through").distinct()
    # one folder per run since the last time
    gone = [f"{path}/run={r['run']}" for r in runs.collect()] + [f"{path}_snapshots/through={r['through']}" for r in snapshots.collect()]
    return sum(delete_path(spark, p) for p in gone)


def write_state_docs(state: DataFrame, path: str, as_of, run_ts, days: int = BACKFILL_CALENDAR_DAYS, tickers_per_doc: int = 10_000) -> None:
    """The state as whole JSON documents (``version, last_updated, window, tickers``), each of about ``tickers_per_doc`` tickers.

    A universe that fits one document gives one; ``read_state_doc`` reads them all.
    """
    docs = max(1, -(-state.count() // tickers_per_doc))
    start, end = backfill_window(as_of, days)
    record = F.struct(*[F.col(f.name) for f in TICKER_STATE_SCHEMA.fields])
    by_doc = state.groupBy(F.pmod(F.xxhash64("ticker"), F.lit(docs)).alias("doc")).agg(F.map_from_entries(F.collect_list(F.struct("ticker", record))).alias("tickers"))
    whole = by_doc.select("doc", F.lit(STATE_VERSION).alias("version"), F.lit(run_ts).cast("timestamp").alias("last_updated"),
                          F.struct(start.alias("start"), end.alias("end")).alias("window"), "tickers")
    whole.write.mode("overwrite").partitionBy("doc").json(path)


def append_audit(audit: DataFrame, path: str) -> None:
    """Append-only error audit, one folder per run date."""
    audit.write.mode("append").partitionBy("run_date").json(path)


def read_audit(spark, path: str, run_date=None) -> DataFrame:
    """The audit entries of all runs, or of one run date; no entries if none were written."""
    from ..sources.files import path_exists
    schema = T.StructType([T.StructField("run_date", T.DateType(), True)] + AUDIT_ERROR_SCHEMA.fields)
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    entries = spark.read.schema(schema).option("mode", "FAILFAST").json(path).select(*schema.fieldNames())
    return entries if run_date is None else entries.where(F.col("run_date") == F.lit(run_date).cast("date"))

"""Bounded, deterministic samples of labelled documents to fit models on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stored

#: Labelled rows a model is fitted on, at most (those with the smallest hashes of their ids).
TRAIN_ROWS = 12_000
#: Rows whose crc32(doc_id as text) mod FOLDS is HELD_OUT are never learned from.
FOLDS, HELD_OUT = 5, 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents, none of them held out; stored in the shared folder.

    Of an id's repeated labels the highest counts, of its repeated texts the
    smallest.  The broadcast side has ``rows`` rows of two numbers at most.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    chosen = usable.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return stored(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")), f"sample-{label}")

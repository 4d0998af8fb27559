"""Mixing sources to target weights: Efraimidis-Spirakis sampling to word budgets, DataFrame operations only.

Every source gets a target number of words.  Whole epochs of the source come
first (each document once per epoch); the rest of the target is drawn without
replacement: document i has the exponential key -ln(u_i) / w_i, with u_i from
a hash of its id and w_i its quality weight, and documents are taken in key
order until the budget is used up (the last one in part).

A source may hold any share of the rows, so its documents are never ordered as
one group.  The key's distribution function maps keys to ``BINS`` bins in key
order; the bins' sizes are summed up per source, which tells for each bin
whether it is taken whole, in part or not at all, and only rows of the same
bin are ordered together.

Edge cases: null and empty texts have size 0 and take nothing; a null source
is a source of its own, ordered last; repeated rows are separate documents,
counted before they are moved and placed one after the other (equal ids in one
source share a key, ties go by size, then by the row's contents in ``mix``);
texts of any length are counted whole; sources without words get the target 0;
an empty table gives an empty mix; extra columns of the input are ignored by
``mix_plan`` and carried through by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_CLASS, each_of, own_name

#: Key-ordered bins per source.
BINS = 2048
#: A source's target stops at so many times its size.
MAX_EPOCHS = 3
#: The sources' weights, in source order, repeating.
WEIGHT_CYCLE = (1, 2, 3)
#: Quality weight of documents by label; documents without a label lie between.
LABEL_WEIGHT = {1: 1.0, 0: 0.25}
UNLABELLED_WEIGHT = 0.5


def word_count(text: Column) -> Column:
    """Number of words between white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: tuple[int, ...] = WEIGHT_CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with weight and target; one row per source.

    Targets are w * level, stopped at ``max_epochs`` times the source's size.
    With the sources ordered by the level at which they stop, each candidate
    level spreads what earlier stops leave over the remaining weights; the true
    level is the highest candidate.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (n % len(cycle) + 1).cast("int"))
    s = sizes.withColumn("weight", weight)
    cap = (F.col("source_size") * max_epochs).cast("double")
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_level", (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * max_epochs).over(earlier), F.lit(0))).cast("double")
                     / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
    s = s.withColumn("_level", F.max("_level").over(everything))
    return s.select("source", "source_size", "weight", F.least(cap, F.col("_level") * F.col("weight")).alias("target"))


def _placed(rows: DataFrame, weights: DataFrame | None, bins: int) -> DataFrame:
    """Counted rows (doc_id, source, size, own, _n) with source_size, target, epochs and _left.

    ``_left`` is what the fractional selection has left of its budget when it
    comes to the first of the _n equal rows; the next ones have ``size`` less each.
    """
    if weights is None:
        rows = rows.withColumn("_w", F.lit(1.0))
    else:
        rows = (rows.join(weights.select(F.col("doc_id").alias("_id"), F.col("weight").alias("_w")), F.col("doc_id") == F.col("_id"), "left")
                .select("doc_id", "source", "size", "own", "_n", F.coalesce("_w", F.lit(UNLABELLED_WEIGHT)).alias("_w")))
    # rows without an id are told apart by their contents, where these are known
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.col("own").cast("string")), F.lit("~"))
    drawn = F.md5(F.concat_ws("|", F.coalesce(F.col("source"), F.lit("~")), name).cast("binary"))
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = (rows.withColumn("_key", -F.log(u) / F.col("_w"))
            .withColumn("_bin", F.least(F.floor((1 - F.exp(-F.col("_key") * UNLABELLED_WEIGHT)) * bins), F.lit(bins - 1)).cast("int")))
    rows = rows.repartition("source", "_bin")        # used by the sums and by the joins below
    sums = rows.groupBy("source", "_bin").agg(F.sum(F.col("size") * F.col("_n")).alias("_words"))
    before = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bin_table = sums.withColumn("_offset", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    per_source = targets(sums.groupBy("source").agg(F.sum("_words").alias("source_size")))
    bin_table = (bin_table.join(per_source.withColumnRenamed("source", "_src"), F.col("source").eqNullSafe(F.col("_src")))
                 .withColumn("epochs", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long"))
                 .withColumn("_budget", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
                 .select(F.col("source").alias("_s"), F.col("_bin").alias("_b"), "source_size", "target", "epochs", "_budget", "_offset"))
    placed = rows.join(bin_table, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_b")))
    inside = Window.partitionBy("source", "_bin").orderBy("_key", "doc_id", "size", "own").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("_left", F.col("_budget") - F.col("_offset") - F.coalesce(F.sum(F.col("size") * F.col("_n")).over(inside), F.lit(0)))


def mix_plan(docs: DataFrame, weights: DataFrame | None = None, bins: int = BINS) -> DataFrame:
    """doc_id, size, source, source_size, target, epochs, extra, taken of every document.

    ``docs`` has doc_id, text and source; ``weights`` (doc_id, weight > 0, one
    row per id) scales the keys.  taken = epochs * size + extra, where extra is
    what the fractional selection takes of the document.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.lit(None).cast("long").alias("own"))
    counted = rows.groupBy("doc_id", "source", "size", "own").agg(F.count(F.lit(1)).alias("_n"))
    placed = each_of(_placed(counted, weights, bins), "_n", "_place")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.col("_place") * F.col("size"))).cast("long")
    return (placed.withColumn("extra", extra)
            .select("doc_id", "size", "source", "source_size", "target", "epochs", "extra", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken")))


def mix(docs: DataFrame, weights: DataFrame | None = None, bins: int = BINS) -> DataFrame:
    """The mix itself: every document as often as it is taken, rows and columns otherwise unchanged.

    A document taken in part comes once more if at least half of it is taken.
    Documents without words come once per epoch of their source.  Equal rows are
    counted before anything is moved and come as often as all of them together;
    rows that differ in any column are documents of their own.  Columns of map or
    variant type are not supported.
    """
    count, own = own_name(docs, "_n"), own_name(docs, "_own")
    distinct = docs.groupBy(*docs.columns).agg(F.count(F.lit(1)).alias(count)).withColumn(own, F.xxhash64(*docs.columns))
    size = word_count(F.col("text"))
    counted = distinct.select("doc_id", "source", size.alias("size"), F.col(own).alias("own"), F.col(count).alias("_n"))
    # of _n equal rows those come once more whose half lies within what is left
    more = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("_n"), F.floor(F.col("_left") / F.col("size") + 0.5)))).otherwise(F.lit(0))
    plan = _placed(counted, weights, bins).select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("own").alias("_row"),
                                                  (F.col("epochs") * F.col("_n") + more).cast("long").alias("_copies"))
    joined = distinct.join(plan.where("_copies > 0"), F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_src")) & (F.col(own) == F.col("_row")))
    return each_of(joined, "_copies", own_name(docs, "_place")).select(*docs.columns)


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights (doc_id, weight) from labels (doc_id, quality): the best label of an id counts."""
    weight = F.when(F.col("quality") == 1, F.lit(LABEL_WEIGHT[1])).when(F.col("quality") == 0, F.lit(LABEL_WEIGHT[0]))
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(weight), F.lit(UNLABELLED_WEIGHT)).alias("weight"))

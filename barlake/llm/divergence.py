"""Source divergence audit: how far the word shares of the sources of a language lie apart, by run-length columns.

Each (language, source) group is a column of counts over the language's kept
terms.  The vocabulary is reordered by its counts, source after source, so that
terms with equal counts in the same groups stand together; terms whose counts
agree in all groups become one row with a length.  The ordered rows are cut
into blocks, and each column of a block is run-length encoded (counts of zero
are runs too).  Two groups are compared by intersecting the run boundaries of
their columns: on each common run both shares are constant, so it adds |p - q|
times its length.

A share is 1 + floor(10^9 (count + 5) / (N + 5 V)), by exact decimals, with N
the group's count over the V kept terms of its language; all sums are integers.

How it keeps to large inputs: tasks count the terms of their own rows in
bounded tables before anything is shuffled; a term's row holds one count per
source; the runs of a block are compared in pairs of source groups of about
``SOURCES`` columns, so a task holds at most two such groups of one block, also
where a language has a third of all text.  The result has a row for each
ordered pair of sources of a language: that is what is asked for.

Edge cases: null text, language and source are read as ''; groups without
terms take part; a language without kept terms has all values 0 and no term
rows; repeated rows are documents of their own; very long texts are counted
in slices, whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, stored

MIN_DOCS, TERM_RANKS = 30, 50
#: Rows of the reordered vocabulary in a block, and columns of a source group.
BLOCK, SOURCES = 8192, 64
#: A task's count tables are handed on when they hold so many terms; texts are counted in slices of so many bytes.
TABLE_TERMS, SLICE_BYTES = 300_000, 1 << 20

#: A-Z lower-cased, a-z and bytes from 0x80 up kept, all others separate terms.
_TERM_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"
_RUNS = "lang string, source string, block long, ends array<long>, counts array<long>"


# --- counting -------------------------------------------------------------------

def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in slices cut between terms."""
    text = text.translate(_TERM_BYTES)
    begin = 0
    while begin < len(text):
        end = text.find(b" ", begin + SLICE_BYTES)
        end = len(text) if end < 0 else end
        yield text[begin:end].split()
        begin = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group, as far as this task's rows go."""
    counts: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    size = 0

    def ready() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            for begin in range(0, len(found), TABLE_TERMS):
                terms = list(found)[begin:begin + TABLE_TERMS]
                n = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                     pa.array([found[t] for t in terms], pa.int64()), pa.array([docs[lang, source][t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        columns = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()
        for lang, source, text in zip(*columns, strict=True):
            if not text:
                continue
            key = (lang, source)
            total, having = counts.setdefault(key, Counter()), docs.setdefault(key, Counter())
            before, once = len(total), set()
            for terms in _terms(text):
                total.update(terms)
                once.update(terms)
            having.update(once)
            size += len(total) - before
            if size >= TABLE_TERMS:
                yield from ready()
                counts, docs, size = {}, {}, 0
    yield from ready()


# --- shares -----------------------------------------------------------------------

def _share(count: str, total: str, v: str) -> str:
    """SQL of 1 + floor(10^9 (count + 5) / (total + 5 v)), exact: decimal operands, integral division."""
    return f"1 + (cast(1000000000 as decimal(10, 0)) * cast({count} + 5 as decimal(19, 0))) div cast({total} + 5 * {v} as decimal(19, 0))"


# --- run-length columns --------------------------------------------------------------

def _block_columns(lengths: np.ndarray, row: np.ndarray, source: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
    """(source, ends, counts) of each source of a block; the column of source None is that of the sources it lacks."""
    ends = np.cumsum(lengths)
    yield None, ends[-1:], np.zeros(1, np.int64)
    names, code = np.unique(source, return_inverse=True)
    order = np.argsort(code, kind="stable")
    bounds = np.searchsorted(code[order], np.arange(len(names) + 1))
    for i, name in enumerate(names):
        at = order[bounds[i]:bounds[i + 1]]
        column = np.zeros(len(lengths), np.int64)
        column[row[at]] = n[at]
        last = np.flatnonzero(np.append(column[1:] != column[:-1], True))      # last row of each run
        yield name, ends[last], column[last]


def _runs(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, profile) -> the run-length columns of their blocks."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        langs = batch.column(0)
        names = langs.to_pylist()
        begins = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)] if names else []
        out: list[tuple] = []
        for lo, hi in zip(begins, begins[1:]):
            for begin in range(lo, hi, block_rows):
                part = batch.slice(begin, min(block_rows, hi - begin))
                profile = part.column(1)
                flat = profile.flatten()
                row = np.repeat(np.arange(len(profile)), np.diff(np.asarray(profile.offsets)))
                source, n = flat.flatten()
                columns = _block_columns(np.asarray(part.column(2)), row, np.asarray(source.to_pylist(), object), np.asarray(n))
                out += [(names[begin], s, block, e, c) for s, e, c in columns]
                block += 1
        if out:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["lang", "source", "block", "ends", "counts"])


def intersect(ends: tuple[np.ndarray, np.ndarray], shares: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum over the common runs of two columns of |p - q| times the run's length."""
    if not len(ends[0]):
        return 0
    cuts = np.union1d(*ends)
    p, q = (s[np.searchsorted(e, cuts)] for e, s in zip(ends, shares, strict=True))
    return int((np.abs(p - q) * np.diff(cuts, prepend=0)).sum())


def _compare(table: pa.Table) -> pa.Table:
    """All pairs of columns of one block between (or within) two source groups."""
    first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
    names, groups = table.column("source").to_pylist(), table.column("group").to_pylist()
    ends, shares = ([np.asarray(x.values, np.int64) for x in table.column(c)] for c in ("ends", "shares"))
    left = [i for i, g in enumerate(groups) if g == first]
    right = [i for i, g in enumerate(groups) if g == second]
    out = [(names[i], names[j], intersect((ends[i], ends[j]), (shares[i], shares[j])))
           for i in left for j in right if first != second or names[i] < names[j]]
    a, b, value = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"lang": pa.array(table.column("lang").to_pylist()[:1] * len(out), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})


# --- the audit -------------------------------------------------------------------------

def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, profile array<struct<source, n>>) of the terms in at least ``min_docs`` documents of their language.

    One shuffle, by (lang, term); within it a term's rows are summed per source first.
    """
    parts = _named(docs).mapInArrow(_count, _COUNTS).repartition("lang", "term")
    by_source = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("profile"))
    return terms.where(F.col("docs") >= min_docs).select("lang", "term", "profile")


def _groups(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, v) of every occurring group, also those without terms."""
    pairs = _named(docs).select("lang", "source").distinct()
    kept = words.select("lang", F.explode("profile").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("total"))
    sizes = words.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(F.aggregate("profile", F.lit(0).cast("long"), lambda a, x: a + x["n"])).alias("lang_total"))
    return (pairs.join(kept, ["lang", "source"], "left").join(sizes, "lang", "left")
            .select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "v"))))


def run_columns(words: DataFrame) -> DataFrame:
    """(lang, source, block, ends, counts): the run-length columns of the reordered vocabulary.

    The order is dealt to as many partitions as the vocabulary has blocks: what
    is sampled for their bounds goes through the driver, and so grows with the
    kept terms, not with the input.
    """
    rows = words.groupBy("lang", "profile").agg(F.count(F.lit(1)).alias("length"))
    ordered = rows.repartitionByRange(max(1, -(-words.count() // BLOCK)), "lang", "profile").sortWithinPartitions("lang", "profile")
    return ordered.mapInArrow(partial(_runs, block_rows=BLOCK), _RUNS)


def _pairs(words: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each ordered pair of sources of a language."""
    runs = stored(run_columns(words), "divergence-runs")
    blocks = runs.where(F.col("source").isNull()).select("lang", "block", F.col("ends").alias("_ends"), F.col("counts").alias("_counts"))
    # every language has a block without terms, so that all of its pairs come out
    none = F.array().cast("array<long>")
    blocks = blocks.unionByName(groups.select("lang").distinct().select("lang", F.lit(-1).cast("long").alias("block"), none.alias("_ends"), none.alias("_counts")))
    many = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCES).cast("int").alias("_groups"))
    members = groups.join(many, "lang").withColumn("group", F.pmod(F.xxhash64("source"), F.col("_groups")).cast("int"))
    columns = blocks.join(members, "lang").join(runs.where(F.col("source").isNotNull()), ["lang", "block", "source"], "left")
    columns = columns.withColumn("counts", F.coalesce("counts", "_counts"))
    shares = F.expr(f"transform(counts, c -> {_share('c', 'total', 'v')})")
    other = F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("other")
    sides = columns.select("lang", "block", "source", "group", F.coalesce("ends", "_ends").alias("ends"), shares.alias("shares"), other)
    sides = sides.withColumn("first", F.least("group", "other")).withColumn("second", F.greatest("group", "other")).drop("other")
    found = sides.groupBy("lang", "block", "first", "second").applyInArrow(_compare, "lang string, a string, b string, value long")
    total = found.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return total.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def _leading_terms(words: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a group has more often than its language."""
    counted = words.select("lang", "term", F.aggregate("profile", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("lang_n"), F.explode("profile").alias("x"))
    rows = counted.select("lang", F.col("x.source").alias("source"), F.col("term").alias("item"), F.col("x.n").alias("n"), "lang_n").join(groups, ["lang", "source"])
    return rows.withColumn("value", F.expr(f"{_share('n', 'total', 'v')} - ({_share('lang_n', 'lang_total', 'v')})")).where("value > 0").select("lang", "source", "item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank of every group of ``docs`` (text, lang, source)."""
    bounded_batches(docs.sparkSession)
    words = stored(vocabulary(docs, min_docs), "divergence-terms")
    groups = stored(_groups(docs, words), "divergence-groups")
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = _pairs(words, groups).withColumn("rank", F.row_number().over(best))
    terms = _leading_terms(words, groups).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= term_ranks)
    both = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return both.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))

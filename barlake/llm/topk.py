"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors are grouped by length into buckets (each ``RATIO`` times as long as
the one before) and buckets are cut into blocks of about ``BLOCK`` rows.  Each
query first takes exact products with the blocks of the longest vectors, which
gives it a floor: its k-th best product so far.  A block of another bucket is
then visited by a query only if |query| * (longest vector of the bucket) can
reach the floor.  Inside a block the local cosine threshold, floor / (|query|
* longest vector), chooses the pruning: a low threshold tells that length alone
removes little, so all products are taken; a high one prunes by the coordinates
first (the part of a product outside the query's strongest coordinates is at
most the product of the two rests' lengths), and whatever stays possible is
verified by its exact product.

All block pairs are independent tasks with bounded input.  Work is exact at
any size; nothing is sampled, and no side is broadcast.

Components become integers floor(256 x), those beyond 64 bits the largest long
of their sign.  A vector is left out if it is null or holds null or non-finite
components.  Products are taken in double precision where they are exact, as
64-bit integers where these hold them, and as Python integers elsewhere; a
product beyond a long counts as the largest long of its sign.  Vectors of
different dimension are compared over the shorter one's coordinates (the
missing ones count as 0).  Ties go to the smaller vec_id; a row is never its own
neighbour, but repeated rows with one vec_id are one candidate with its best
product; rows with a null vec_id are left out; empty tables and k larger than
the table give what there is; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, stored

SCALE = 256.0
LONGEST = (1 << 63) - 1
RATIO = 1.1
#: Rows of a block of candidates and of queries.
BLOCK, QUERY_BLOCK = 1024, 512
#: Candidates, the longest ones, from which the floors are taken.
SEED_ROWS = 1024
#: Local cosine threshold from which coordinates are used for pruning, and how many of them.
COORDINATE_FROM, COORDINATES = 0.6, 16
_TOP = "query_id long, vec_id long, score long"


def _integer(x: Column) -> Column:
    """floor(x) as a long; beyond its range the end of the range."""
    return F.when(x >= 2.0 ** 63, F.lit(LONGEST)).when(x < -(2.0 ** 63), F.lit(-LONGEST - 1)).otherwise(F.floor(x))


def quantise(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<long>, norm) of the vectors that take part."""
    q = F.transform("embedding", lambda x: _integer(x.cast("double") * SCALE))
    usable = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    rows = vectors.where(F.col("vec_id").isNotNull() & usable).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def _bucket(norm: Column) -> Column:
    return F.when(norm > 0, F.floor(F.log(norm) / F.lit(float(np.log(RATIO))))).otherwise(F.lit(-1)).cast("int")


def _blocked(rows: DataFrame) -> DataFrame:
    """``rows`` with their bucket and block (within the bucket, by a hash of the id)."""
    rows = rows.withColumn("bucket", _bucket(F.col("norm")))
    # at most log(2^63 * dimension) / log(RATIO) buckets, some thousand short rows: safe to broadcast
    counts = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    return (rows.join(F.broadcast(counts), "bucket").withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("_blocks")).cast("int"))
            .select("bucket", "block", "vec_id", "v", "norm"))


def _matrix(column: pa.Array, width: int | None = None, dtype=np.float64) -> np.ndarray:
    """The vectors as rows, padded with zeros (in float64 only bounds and small integers are exact)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.flatten()).astype(dtype)
    width = width or max(int(lengths.max(initial=0)), 1)
    out = np.zeros((len(column), width), dtype)
    inside = np.arange(width) < lengths[:, None]
    out[inside] = values
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query's candidates: score down, then id up."""
    if len(ids) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(ids))
    return at[np.lexsort((ids[at], ~scores[at]))][:k]                      # ~x falls as x rises, over the whole range


def _exact_type(longest: float) -> type:
    """The number type in which products of at most that length are exact."""
    return np.float64 if longest < 2.0 ** 52 else np.int64 if longest < 2.0 ** 62 else object


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All products; those of Python integers as the nearest long."""
    if q.dtype != object:
        return q @ v.T
    return np.array([[max(min(sum(x * y for x, y in zip(a, b)), LONGEST), -LONGEST - 1) for b in v.tolist()] for a in q.tolist()], np.int64).reshape(len(q), len(v))


def _block_top(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """The k best of one block of candidates for each query of one block."""
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    if not queries.num_rows or not vectors.num_rows:
        return empty
    q, v = _matrix(queries.column("v")), _matrix(vectors.column("v"))
    width = max(q.shape[1], v.shape[1])
    q, v = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, v))
    q_ids, v_ids = np.asarray(queries.column("vec_id")), np.asarray(vectors.column("vec_id"))
    least = np.asarray(queries.column("floor").fill_null(-LONGEST - 1), np.int64)
    floors = np.where(least == -LONGEST - 1, -np.inf, least.astype(np.float64))     # for bounds
    q_norms, longest = np.asarray(queries.column("norm")), float(np.asarray(vectors.column("norm")).max())
    v_norms = np.asarray(vectors.column("norm"))
    exact = _exact_type(float(q_norms.max() * longest))
    qx, vx = (q, v) if exact is np.float64 else (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (_matrix(t.column("v"), dtype=exact) for t in (queries, vectors)))
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(q_norms * longest > 0, floors / (q_norms * longest), -np.inf)
    repeated = len(np.unique(v_ids)) < len(v_ids)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def take(i: int, at: np.ndarray, scores: np.ndarray) -> None:
        scores = scores.astype(np.int64)
        ok = (v_ids[at] != q_ids[i]) & (scores >= least[i])
        ids, scores = v_ids[at][ok], scores[ok]
        if repeated:                                       # a vec_id takes one of the k places, with its best product
            order = np.lexsort((~scores, ids))
            ids, scores = ids[order], scores[order]
            first = np.concatenate(([True], ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
            ids, scores = ids[first], scores[first]
        best = _best(ids, scores, k)
        out.append((np.full(len(best), q_ids[i]), ids[best], scores[best]))

    by_length = np.flatnonzero(cosine < COORDINATE_FROM)
    if len(by_length):
        scores = _products(qx[by_length], vx)
        for row, i in enumerate(by_length.tolist()):
            take(i, np.arange(len(v_ids)), scores[row])
    for i in np.flatnonzero(cosine >= COORDINATE_FROM).tolist():
        strong = np.argsort(-np.abs(q[i]), kind="stable")[:COORDINATES]
        part = v[:, strong]
        rest_q = np.sqrt(max(float((q[i] ** 2).sum() - (q[i][strong] ** 2).sum()), 0.0))
        rest_v = np.sqrt(np.maximum(v_norms ** 2 - (part ** 2).sum(axis=1), 0.0))
        bound = part @ q[i][strong] + rest_q * rest_v
        at = np.flatnonzero(bound * (1 + 1e-9) + 1 >= floors[i])          # the slack covers rounding; products decide
        if len(at):
            take(i, at, _products(qx[i:i + 1], vx[at])[0])
    if not out:
        return empty
    return pa.table({"query_id": pa.array(np.concatenate([x[0] for x in out]), pa.int64()), "vec_id": pa.array(np.concatenate([x[1] for x in out]), pa.int64()),
                     "score": pa.array(np.concatenate([x[2] for x in out]).astype(np.int64), pa.int64())})


def _k_best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's block results (at most k per block); a repeated vec_id counts once."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _visit(queries: DataFrame, vectors: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Block results of the (query block, candidate block) pairs that are asked for."""
    keys = ["q_block", "bucket", "block"]
    fresh = [F.col(c).alias(c) for c in keys]                     # both sides come from the same frames
    q = queries.join(pairs, "q_block").select(*fresh, "vec_id", "v", "norm", "floor")
    v = vectors.join(pairs, ["bucket", "block"]).select(*keys, "vec_id", "v", "norm")
    return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(partial(_block_top, k=k), _TOP)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of ``vectors`` for each of ``queries`` (vec_id, embedding each)."""
    bounded_batches(vectors.sparkSession)
    rows = stored(_blocked(quantise(vectors).dropDuplicates(["vec_id", "v"])), "top-k-blocks")
    asked = quantise(queries).dropDuplicates(["vec_id", "v"])
    n_q = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("q_block", F.pmod(F.xxhash64("vec_id"), F.lit(n_q)).cast("int")).withColumn("floor", F.lit(None).cast("long"))
    blocks = rows.groupBy("bucket", "block").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"))
    longer = Window.orderBy(F.col("bucket").desc(), "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("seed", F.coalesce(F.sum("n").over(longer), F.lit(0)) < SEED_ROWS + k)
    pairs = blocks.select("bucket", "block", "top", "seed", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q_block"))
    # exact products with the longest vectors give each query its floor
    seeds = _k_best(_visit(asked, rows, pairs.where("seed").select("bucket", "block", "q_block"), k), k)
    seeds = stored(seeds.select("query_id", "vec_id", "score"), "top-k-seeds")
    floors = seeds.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    asked = stored(asked.drop("floor").join(floors, F.col("vec_id") == F.col("query_id"), "left").drop("query_id"), "top-k-queries")
    # length pruning of whole blocks: some query of the block must be able to reach its floor
    needs = asked.groupBy("q_block").agg(F.min(F.coalesce(F.col("floor") / F.greatest(F.col("norm"), F.lit(1e-9)), F.lit(float("-inf")))).alias("need"))
    todo = pairs.where(~F.col("seed")).join(needs, "q_block").where(F.col("top") * (1 + 1e-9) >= F.col("need")).select("bucket", "block", "q_block")
    found = _k_best(seeds.unionByName(_visit(asked, rows, todo, k)), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

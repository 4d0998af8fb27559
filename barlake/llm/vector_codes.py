"""Product codes of vectors: each part is replaced by the index of its nearest codebook entry, in integers throughout.

Components become integers floor(256 x).  Vectors are cut into equal parts;
each part position has a codebook that starts from the vectors with the
smallest ids and is refined by rounds of assignment and averaging (floor of
the mean).

The nearest entry is found in the Walsh-Hadamard domain: parts and entries are
padded with zeros to a power of two P and transformed by sums and differences.
The transform keeps distances up to the factor P, so the squared differences
of the first coefficients, taken in sequency order (slowly changing patterns
first, where most of the energy lies), never exceed P times the distance.  The
entry that is nearest in the first coefficient gives every part an upper
bound; an entry whose running sum is above it is eliminated, the others go on
to the next coefficient.  No floating point is involved: 64-bit integers where
the sums provably fit, Python integers elsewhere.

A pass over the vectors runs on Spark without a shuffle; a round's sums are
combined by (part, entry, position).  Only the codebooks, ``entries`` times the
dimension, go through the driver and to the tasks.

Edge cases: a vector is left out if it is null or holds null or non-finite
components, and for nothing else: integers have any length.  Vectors shorter than
the longest one, and a dimension that is no multiple of the parts, are
continued with zeros (an empty vector is all zeros).  A repeated vec_id gives
one seed, its smallest vector; null ids come last.  Ties go to the lower
index.  Fewer vectors than entries give a smaller codebook, an empty table
gives no rows.  ``error`` and ``label_error`` are null where they exceed a
long.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Integers up to so many bits are 64-bit ones; longer sums are added up in limbs of this length.
BITS = 62
_SUMS = "part int, entry int, position int, limb int, total long, n long"
_CODES = "vec_id {id}, label {label}, code string, error string"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v array<double>) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("string")
    return vectors.where(F.coalesce(finite, F.lit(False))).select("vec_id", label.alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


# --- transform and search -----------------------------------------------------

def sequency_order(p: int) -> np.ndarray:
    """Rows of the natural-order Hadamard matrix of size p, by their number of sign changes (0 to p - 1)."""
    i = np.arange(p)
    signs = np.array([[bin(a & b).count("1") & 1 for b in i] for a in i])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


def transform(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of integer rows, padded to a power of two, coefficients in sequency order."""
    d = rows.shape[1]
    p = 1 << max(d - 1, 0).bit_length()
    out = np.zeros((len(rows), p), rows.dtype)
    out[:, :d] = rows
    half = 1
    while half < p:
        out = out.reshape(len(rows), -1, 2, half)
        out = np.concatenate((out[:, :, :1] + out[:, :, 1:], out[:, :, :1] - out[:, :, 1:]), axis=2).reshape(len(rows), p)
        half *= 2
    return out[:, sequency_order(p)]


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as they are if all sums of their search fit 64 bits, else as Python integers."""
    d = arrays[0].shape[1]
    p = 1 << max(d - 1, 0).bit_length()
    top = max(int(abs(a).max(initial=0)) for a in arrays)
    return [a.astype(np.int64 if p * p * 4 * top * top < 1 << BITS else object, copy=False) for a in arrays]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower one) and squared distance, for each row of ``parts``."""
    if not len(parts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts, entries = _exact(parts, entries)
    a, b = transform(parts), transform(entries)
    p = a.shape[1]
    first = (a[:, :1] - b[:, 0]) ** 2
    guess = first.argmin(axis=1)
    bound = ((a - b[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= bound[:, None])
    total = first[row, entry]
    for c in range(1, p):
        total = total + (a[row, c] - b[entry, c]) ** 2
        alive = total <= bound[row]
        row, entry, total = row[alive], entry[alive], total[alive]
    begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))    # rows keep at least their guess
    least = np.minimum.reduceat(total, begin)
    hit = np.flatnonzero(total == least[row])
    hit = hit[np.concatenate(([True], row[hit][1:] != row[hit][:-1]))]
    return entry[hit], least // p


# --- passes over the vectors ----------------------------------------------------

def _integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) as rows of ``width``, continued with zeros: int64, or Python integers if one is too long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(np.asarray(column.offsets))
    x = np.asarray(column.flatten(), np.float64)
    if abs(x).max(initial=0.0) < (1 << BITS) // SCALE:
        found = np.floor(x * SCALE).astype(np.int64)
    else:
        # from 2^53 on a double is whole, and its product might leave the doubles
        found = np.array([math.floor(v * SCALE) if abs(v) < 1 << 53 else int(v) * SCALE for v in x.tolist()], object)
    out = np.zeros((len(column), width), found.dtype)
    out[np.arange(width) < lengths[:, None]] = found
    return out


def limbs(total: int) -> list[int]:
    """Two's complement limbs of an integer, the lowest first; only the last one has a sign."""
    out = []
    while not -(1 << BITS) <= total < 1 << BITS:
        out.append(total & (1 << BITS) - 1)
        total >>= BITS
    return [*out, total]


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each entry of each part, the sum and number of this task's parts that are assigned to it."""
    m, k, d = books.shape
    total, count = np.zeros((m, k, d), object), np.zeros((m, k), np.int64)
    for batch in batches:
        rows = _integers(batch.column("v"), m * d).reshape(-1, m, d)
        small = int(abs(rows).max(initial=0)) * max(len(rows), 1) < 1 << BITS
        for j in range(m):
            entry, _ = nearest(rows[:, j], books[j])
            part = np.zeros((k, d), np.int64 if small else object)
            np.add.at(part, entry, rows[:, j] if small else rows[:, j].astype(object))
            total[j] += part.astype(object)
            count[j] += np.bincount(entry, minlength=k)
    found = [(j, e, i, limb, x, count[j, e]) for j, e in np.argwhere(count).tolist() for i in range(d) for limb, x in enumerate(limbs(int(total[j, e, i])))]
    if found:
        columns = zip(*found, strict=True)
        kinds = [pa.int32()] * 4 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "entry", "position", "limb", "total", "n"])


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    m, _, d = books.shape
    for batch in batches:
        rows = _integers(batch.column("v"), m * d).reshape(-1, m, d)
        code, error = np.zeros((len(rows), m), np.uint8), np.zeros(len(rows), object)
        for j in range(m):
            entry, distance = nearest(rows[:, j], books[j])
            code[:, j] = entry
            error += distance.astype(object)
        text = code.tobytes().hex()
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([text[i:i + 2 * m] for i in range(0, len(text), 2 * m)], pa.string()),
                                          pa.array([str(x) for x in error], pa.string())], ["vec_id", "label", "code", "error"])


# --- codebooks --------------------------------------------------------------------

def _seeds(rows: DataFrame, entries: int) -> list:
    """The vectors of the smallest distinct ids: ``entries`` rows at most."""
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = rows.select("vec_id", "v").orderBy(*order).limit(entries).collect()
    if len({r["vec_id"] for r in first}) < len(first):       # repeated ids: one vector each
        first = rows.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(*order).limit(entries).collect()
    return [r["v"] for r in first]


def learn_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Integers [part, entry, position]; None without usable vectors.  At most 256 entries (a code has two digits a part)."""
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    bounded_batches(vectors.sparkSession)
    rows = usable(vectors)
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    d = max(1, -(-longest // parts))
    seeds = pa.array(_seeds(rows, entries), pa.list_(pa.float64()))
    books = np.ascontiguousarray(_integers(seeds, parts * d).reshape(-1, parts, d).transpose(1, 0, 2))
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(partial(_sums, books=books), _SUMS)
        found = sums.groupBy("part", "entry", "position", "limb").agg(F.sum(F.col("total").cast("decimal(19,0)")).alias("total"), F.sum("n").alias("n"))
        total, n = np.zeros(books.shape, object), np.zeros(books.shape, np.int64)
        for r in found.collect():                             # at most entries * dimension rows, and a few limbs for huge components
            at = r["part"], r["entry"], r["position"]
            total[at] += int(r["total"]) << BITS * r["limb"]
            n[at] = max(n[at], r["n"])                        # every sum has the lowest limb
        books = np.where(n > 0, total // np.maximum(n, 1).astype(object), books)    # entries without parts stay
    return books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every usable vector."""
    rows = usable(vectors)
    types = dict(rows.dtypes)
    found = rows.mapInArrow(partial(_codes, books=books), _CODES.format(id=types["vec_id"], label=types["label"]))
    return found.withColumn("error", F.col("error").try_cast("long"))


def decode(code: str, books: np.ndarray) -> list[int]:
    """The integer vector that a code stands for (padding included)."""
    return [int(x) for j in range(books.shape[0]) for x in books[j, int(code[2 * j:2 * j + 2], 16)]]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector (vec_id, embedding, label)."""
    books = learn_codebooks(vectors, parts, entries, rounds)
    if books is None:
        books = np.zeros((parts, 1, 1), np.int64)             # no rows follow
    codes = stored(encode(vectors, books), "vector-codes")
    # written first, so that Spark sees how few labels there are; many labels are joined by a shuffle
    sums = stored(codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count_if(F.col("error").isNull()).alias("_without")), "label-errors")
    sums = sums.select(F.col("label").alias("_label"), F.when(F.col("_without") == 0, F.col("label_error")).alias("label_error"))
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))

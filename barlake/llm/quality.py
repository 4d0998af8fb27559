"""Quality scores by Bradley-Terry pairwise ranking.

Every text becomes a short vector of surface statistics (characters by kind,
word repetition, word shapes).  On a bounded sample of labelled documents each
better document is paired with worse ones; the weights minimise the logistic
loss of the feature differences, so a document's score is its strength in the
Bradley-Terry sense.  The strength is then cut at a quantile of the sample's
strengths (the one that classifies the sample best) and mapped to 0..1 so that
this quantile lies at ``THRESHOLD``.

Edge cases: null and empty texts have a vector of zeros and a score like any
other; without labels of both kinds all scores are equal and count as good;
repeated rows are scored alike; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out
from .labelled import FOLDS, HELD_OUT, TRAIN_ROWS, labelled_sample
from .words import SPACED_LOWER, slices, words

THRESHOLD = 0.3
#: Preference pairs per document of the sample, and the weight of the L2 penalty.
PAIRS_PER_DOCUMENT, PENALTY = 16, 1e-3

_KINDS = ("lower", "upper", "digit", "stop", "symbol", "space", "line", "other")
FEATURES = (*_KINDS, "log_words", "word_length", "repeated", "second", "distinct", "distinct_by_length", "capital_words", "symbol_words", "bare_symbols", "long_words")


def _kind_table() -> np.ndarray:
    kind = np.full(256, _KINDS.index("symbol"), np.uint8)
    kind[ord("a"):ord("z") + 1] = _KINDS.index("lower")
    kind[ord("A"):ord("Z") + 1] = _KINDS.index("upper")
    kind[ord("0"):ord("9") + 1] = _KINDS.index("digit")
    kind[list(b".,;:'\"()-?")] = _KINDS.index("stop")
    kind[list(b" \t")] = _KINDS.index("space")
    kind[list(b"\n\r\x0b\x0c")] = _KINDS.index("line")
    kind[128:] = _KINDS.index("other")
    return kind


_KIND = _kind_table()


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text of an Arrow column."""
    blocks = [np.zeros((0, len(FEATURES)))]
    for s in slices(column):
        n_texts, n_bytes = len(s.offsets) - 1, np.diff(s.offsets)
        w = words(s, SPACED_LOWER)
        h, n_words = w.hashes[0], np.diff(w.first)
        text = w.text_of_word()
        kind = _KIND[s.data]
        in_text = np.repeat(np.arange(n_texts), n_bytes)
        by_kind = np.bincount(in_text * len(_KINDS) + kind, minlength=n_texts * len(_KINDS)).reshape(n_texts, len(_KINDS))
        same = np.zeros(len(h)), np.zeros(len(h))
        for far, out in ((1, same[0]), (2, same[1])):
            out[far:] = (h[far:] == h[:-far]) & (text[far:] == text[:-far]) if len(h) > far else 0
        order = np.lexsort((h, text))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
        length = w.end - w.start
        first_kind, last_kind = (kind[w.start], kind[w.end - 1]) if len(h) else (kind[:0], kind[:0])
        symbol, upper, lower = (_KINDS.index(x) for x in ("symbol", "upper", "lower"))
        per_word = (length, same[0], same[1], (first_kind == upper) & (last_kind != lower), (last_kind == symbol) & (first_kind != symbol), first_kind == symbol, length > 20)
        sums = [np.bincount(text, weights=x, minlength=n_texts) if len(h) else np.zeros(n_texts) for x in per_word]
        distinct = np.bincount(text[order][new], minlength=n_texts) if len(h) else np.zeros(n_texts)
        n = np.maximum(n_words, 1)
        log_n = np.log1p(n_words)
        share = distinct / n
        blocks.append(np.column_stack([by_kind / np.maximum(n_bytes, 1)[:, None], log_n, sums[0] / n, sums[1] / n, sums[2] / n, share, share * log_n,
                                       sums[3] / n, sums[4] / n, sums[5] / n, sums[6] / n]))
    return np.concatenate(blocks)


class Ranking(NamedTuple):
    """strength = weights . clip((features - mean) / spread); score = 0.3 at the strength ``cut``."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.strength(x) - self.cut) / self.scale + math.log(THRESHOLD / (1 - THRESHOLD))
        z = np.clip(z, -30, 30)
        out = 1 / (1 + np.exp(-z))
        return np.where(self.strength(x) >= self.cut, np.maximum(out, THRESHOLD), np.minimum(out, np.nextafter(THRESHOLD, 0)))


def fit(x: np.ndarray, y: np.ndarray) -> Ranking:
    """Weights from preference pairs (a row with y = 1 over one with y = 0), cut by a quantile of the strengths."""
    if not (y == 1).any() or not (y == 0).any():
        k = len(FEATURES)
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 1.0)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1.0
    z = np.clip((x - mean) / spread, -6, 6)
    rng = np.random.default_rng(7)
    n = PAIRS_PER_DOCUMENT * len(y)
    better, worse = rng.choice(np.flatnonzero(y == 1), n), rng.choice(np.flatnonzero(y == 0), n)
    d = z[better] - z[worse]
    weights = np.zeros(z.shape[1])
    for _ in range(50):                                  # Newton steps on the mean logistic loss
        p = 1 / (1 + np.exp(np.clip(d @ weights, -30, 30)))
        slope = -(d * p[:, None]).mean(axis=0) + PENALTY * weights
        curve = (d * (p * (1 - p))[:, None]).T @ d / n + PENALTY * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    strength = z @ weights
    order = np.argsort(strength, kind="stable")
    ranked, good = strength[order], y[order] == 1
    # quantile i: the i weakest are called bad; right are the bad ones below and the good ones above
    right = np.concatenate(([0], np.cumsum(~good))) + np.concatenate((np.cumsum(good[::-1])[::-1], [0]))
    right[1:-1][ranked[1:] == ranked[:-1]] = -1          # equal strengths can't be parted
    i = int(right.argmax())
    low, high = ranked[max(i - 1, 0)], ranked[min(i, len(ranked) - 1)]
    return Ranking(mean, spread, weights, float((low + high) / 2) if 0 < i < len(ranked) else float(ranked[0] - 1 if i == 0 else ranked[-1] + 1),
                   max(1.0, float(np.subtract(*np.quantile(strength, (0.9, 0.1)))) / 8))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Ranking:
    """A ranking fitted on at most ``rows`` labelled documents, none of them held out."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", rows)
    got = sample.mapInArrow(_vectors, "y int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(got.column("y"), int)
    order = np.lexsort((*x.T, y))                         # the order rows arrive in doesn't matter
    return fit(x[order], y[order])


def _scores(batches: Iterator[pa.RecordBatch], ranking: Ranking) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = ranking.score(features(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = docs.select("doc_id", "text").mapInArrow(partial(_scores, ranking=ranking), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Language identification: known words first, backing off to ever shorter character n-grams.

The model holds, per language, log frequencies of words and of character
n-grams (of words with a space on both sides).  A text's score for a language
is the sum over its words: a known word counts with its log frequency, an
unseen one with the mean log frequency of its longest n-grams that are known.
The model is learned from a sample of ``DOCS_PER_LANGUAGE`` documents a
language (drawn by a hash of the id, so about that many; of an id's repeated
texts the smallest), counted on Spark.  Every entry that occurs ``LEAST`` times
in the sample is kept; an entry lists only the languages that have it, so the
model grows with the sample and not with entries times languages.

Edge cases: a null text, or one without letters, is ``und`` with score 0, and
so is everything if no language was learned; ties go to the first language by
code point; repeated rows are predicted alike; very long texts are read whole;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, stored, unit

UNDETERMINED = "und"
#: Rows whose crc32(doc_id as text) mod FOLDS is HELD_OUT are never learned from.
FOLDS, HELD_OUT = 4, 2
DOCS_PER_LANGUAGE = 1500
#: Longest n-grams, and the least count of an entry.
GRAM, LEAST = 4, 2
_SMOOTHING = 0.1
_WORD = re.compile(r"[^\W\d_]+")


def _grams(word: str, n: int) -> Iterator[str]:
    padded = f" {word} "
    return (padded[i:i + n] for i in range(len(padded) - n + 1))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        per_lang: dict[str, Counter] = defaultdict(Counter)
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            per_lang[lang].update(_WORD.findall((text or "").lower()))
        for lang, found in per_lang.items():
            entries = Counter({(0, w): n for w, n in found.items()})
            for w, times in found.items():
                for n in range(1, GRAM + 1):
                    for g in _grams(w, n):
                        entries[n, g] += times
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(entries), pa.string()), pa.array([n for n, _ in entries], pa.int32()),
                                              pa.array([k for _, k in entries], pa.string()), pa.array(list(entries.values()), pa.int64())],
                                             names=["lang", "kind", "entry", "n"])


class Table(NamedTuple):
    """Entries of one kind: ``rows`` maps an entry to a row; a row lists the languages that have it and how far their log frequency is above ``base``."""
    rows: dict[str, int]
    begin: np.ndarray      # entries + 1
    lang: np.ndarray
    above: np.ndarray
    base: np.ndarray       # per language, the log frequency of an entry it lacks

    def sums(self, rows: list[int], weights: np.ndarray) -> np.ndarray:
        """Per language, the weighted sum of the rows' log frequencies."""
        at = np.asarray(rows, np.int64)
        begin, n = self.begin[at], self.begin[at + 1] - self.begin[at]
        place = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return self.base * weights.sum() + np.bincount(self.lang[place], np.repeat(weights, n) * self.above[place], len(self.base))


class Model:
    """Log frequencies of entries by kind (0: words, n: n-grams); an entry costs what the languages that have it cost."""

    def __init__(self, counts: list[tuple[str, int, str, int]]):
        self.languages = sorted({c[0] for c in counts})
        column = {lang: i for i, lang in enumerate(self.languages)}
        by_kind: list[list[tuple[str, int, int]]] = [[] for _ in range(GRAM + 1)]
        for lang, kind, entry, n in counts:
            by_kind[kind].append((entry, column[lang], n))
        self.tables = [self._table(sorted(of)) for of in by_kind]

    def _table(self, of: list[tuple[str, int, int]]) -> Table:
        rows: dict[str, int] = {}
        row = np.array([rows.setdefault(e, len(rows)) for e, _, _ in of], np.int64)
        lang, n = np.array([c for _, c, _ in of], np.int32), np.array([x for _, _, x in of], np.float64)
        total = np.log(np.bincount(lang, n, len(self.languages)) + _SMOOTHING * (len(rows) + 1))
        return Table(rows, np.searchsorted(row, np.arange(len(rows) + 1)), lang, (np.log(n + _SMOOTHING) - np.log(_SMOOTHING)).astype(np.float32), np.log(_SMOOTHING) - total)

    def _unseen(self, words: list[str], times: list[int]) -> np.ndarray:
        """Sum of the backoffs of unseen words: each word's longest known n-grams, by their mean log frequency."""
        rows: list[list[int]] = [[] for _ in range(GRAM + 1)]
        weights: list[list[float]] = [[] for _ in range(GRAM + 1)]
        for word, n in zip(words, times, strict=True):
            padded = f" {word} "
            for size in range(GRAM, 0, -1):
                table = self.tables[size].rows
                known = [table[g] for g in [padded[i:i + size] for i in range(len(padded) - size + 1)] if g in table]
                if known:
                    rows[size] += known
                    weights[size] += [n / len(known)] * len(known)
                    break
        total = np.zeros(len(self.languages))
        for size in range(1, GRAM + 1):
            if rows[size]:
                total += self.tables[size].sums(rows[size], np.array(weights[size]))
        return total

    def backoff(self, word: str) -> np.ndarray:
        """Mean log frequency of the longest known n-grams of a word; zeros without any."""
        return self._unseen([word], [1])

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the posterior probability of it under equal priors, words tempered to 40 at most."""
        found = Counter(_WORD.findall((text or "").lower()))
        if not found or not self.languages:
            return UNDETERMINED, 0.0
        rows = list(map(self.tables[0].rows.get, found))
        times = list(found.values())
        unseen = [i for i, r in enumerate(rows) if r is None]
        total = np.zeros(len(self.languages))
        if unseen:
            words = list(found)
            total += self._unseen([words[i] for i in unseen], [times[i] for i in unseen])
            rows, times = [r for r in rows if r is not None], [n for r, n in zip(rows, times, strict=True) if r is not None]
        if rows:
            total += self.tables[0].sums(rows, np.array(times, np.float64))
        words_in_text = sum(found.values())
        best = int(total.argmax())
        odds = np.exp((total - total[best]) * min(1.0, 40 / words_in_text))
        return self.languages[best], float(1 / odds.sum())


def learn(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """A model from a sample of the documents with a language, none of them held out."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    shares = rows.groupBy("lang").agg((F.lit(float(docs_per_language)) / F.count(F.lit(1))).alias("share"))
    # ids first, texts later: the stored choice is as small as the parameter says, so Spark need not shuffle any text
    chosen = rows.distinct().join(shares, "lang").where(unit(F.xxhash64(F.lit("langid"), "doc_id")) < F.col("share")).select("doc_id", "lang")
    chosen = stored(chosen, "langid-sample")
    sample = docs.where("text is not null").select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    counted = sample.mapInArrow(_counts, "lang string, kind int, entry string, n long").groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    counts = counted.toArrow()                              # as large as the sample makes it, whatever the corpus
    return Model(list(zip(*(counts.column(c).to_pylist() for c in ("lang", "kind", "entry", "n")), strict=True)))


def _predict(batches: Iterator[pa.RecordBatch], broadcast) -> Iterator[pa.RecordBatch]:
    model = broadcast.value
    for batch in batches:
        found = [model.predict(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                                         names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    work = partial(_predict, broadcast=docs.sparkSession.sparkContext.broadcast(model))
    found = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")

"""Toxicity: a weighted lexicon of word stems, matched by Aho-Corasick on folded text, normalised by length.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones
and digit or symbol substitutions inside words to letters, drops zero-width
characters, and turns everything that is no letter into a space.  A lexicon
entry matches at the begin of a word; matches inside an exception phrase don't
count.  The rate of a text is the sum of the matched weights over its number
of words, and its score is rate / (rate + threshold), so 0.5 is the threshold.

The lexicon is learned from a bounded sample of labelled documents.  Stems
(word beginnings) of toxic documents that clean ones hardly have are candidates;
their weight is the log-odds ratio of the two document frequencies.  Greedy
covering picks stems as long as they explain enough toxic documents that have
fewer than ``COVER`` other matches; near copies of a document (equal minimum
word hash) count once, so that words of an often copied document don't pass as
lexicon.  Words that begin with a picked stem, and their pairs with the word
before or after, become exception phrases if different clean documents have
them and toxic ones hardly do.  The threshold is the one that separates the
sample best.

Edge cases: a null or empty text, or one without letters, scores 0; without
usable labels only the seed stems count; repeated rows are scored alike;
empty tables give empty results; extra columns are ignored by ``score`` and
kept by ``reject``.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, stored
from .labelled import FOLDS, HELD_OUT, TRAIN_ROWS, labelled_sample

THRESHOLD = 0.5
STEM_LENGTHS = range(3, 13)
#: Toxic documents that must support a stem, as a number and as a share of those in the sample.
SUPPORT, SUPPORT_SHARE = 4, 0.004
MIN_WEIGHT, MIN_PRECISION = 3.0, 0.9
#: Toxic documents that a stem must gain for each clean one that has it.
CLEAN_COST = 2
#: Distinct matches that explain a toxic document.
COVER = 2
#: Counts that a task holds before it hands them on.
COUNTED = 1 << 18
#: Stems that count without any label, and their weight (a parameter: any words with weights will do).
SEED_STEMS = {"idiot": 6.0, "moron": 6.0, "scumbag": 6.0, "asshole": 6.0, "bastard": 6.0}
#: Phrases in which a stem is harmless, besides those learned (a parameter).
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "oxymoron")

# Letters of other scripts that look like Latin ones, and substitutions inside words.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ɩ": "i", "ո": "n", "ս": "u", "օ": "o", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ℓ": "l",
}
_SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Fold(dict):
    """Translation table, filled as characters are met."""

    def __missing__(self, code: int):
        c = chr(code)
        low = c.lower()
        if 0xFF01 <= code <= 0xFF5E:                                   # full-width forms
            out = self[code - 0xFEE0]
        elif 0x1D400 <= code <= 0x1D6A3:                               # mathematical Latin letters: 26 capital, 26 small, repeating
            out = chr(ord("a") + (code - 0x1D400) % 26)
        elif code in (0xAD, 0xFEFF) or 0x200B <= code <= 0x200F or 0x2060 <= code <= 0x2064:
            out = None                                                  # soft hyphen, zero-width characters
        else:
            out = _LOOKALIKES.get(low) or _SUBSTITUTIONS.get(c) or (low if c.isalpha() else " ")
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """The text as the lexicon sees it: lower-case words with a space before each."""
    return " " + text.translate(_FOLD)


def _word_set(text: str | None) -> set[str]:
    return set(fold(text or "").split())


def _copy_key(found: set[str]) -> int:
    return min((zlib.crc32(w.encode()) for w in found), default=0)


def _stems(word: str) -> Iterator[str]:
    for n in STEM_LENGTHS:
        if n <= len(word):
            yield word[:n]


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, stem, copy, n): n rows of a task have the stem; copy is the copy key of a toxic row, null for clean ones.

    The empty stem counts the rows themselves.  Counts are handed on whenever
    there are ``COUNTED`` of them, so that memory has a bound besides one text.
    """
    schema = pa.schema([("y", pa.int32()), ("stem", pa.string()), ("copy", pa.int64()), ("n", pa.int64())])
    counts: Counter[tuple] = Counter()

    def counted() -> pa.RecordBatch:
        y, stem, copy = zip(*counts, strict=True) if counts else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((y, stem, copy, list(counts.values())), schema, strict=True)], schema=schema)

    for batch in batches:
        for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            found = _word_set(t)
            copy = _copy_key(found) if y else None
            counts.update((y, s, copy) for s in {"", *(s for w in found for s in _stems(w))})
            if len(counts) >= COUNTED:
                yield counted()
                counts.clear()
    yield counted()


def _matching_words(batches: Iterator[pa.RecordBatch], stems: Broadcast) -> Iterator[pa.RecordBatch]:
    """Copy key, and the words that begin with one of the stems, of each text that has any."""
    for batch in batches:
        copies, words = [], []
        for t in batch.column("text").to_pylist():
            found = _word_set(t)
            matching = sorted(w for w in found if any(s in stems.value for s in _stems(w)))
            if matching:
                copies.append(_copy_key(found)), words.append(matching)
        yield pa.RecordBatch.from_arrays([pa.array(copies, pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["copy", "words"])


def _phrases_with_stems(batches: Iterator[pa.RecordBatch], stems: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(y, copy, phrase): the distinct words that begin with a stem, alone and with the word before or after them, of each text."""
    for batch in batches:
        out = []
        for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            words = fold(t or "").split()
            phrases = set()
            for i, w in enumerate(words):
                if w.startswith(stems):
                    phrases.update((w, *(" ".join(words[a:a + 2]) for a in (i - 1, i) if 0 <= a < len(words) - 1)))
            if phrases:
                copy = _copy_key(set(words))
                out += [(y, copy, p) for p in phrases]
        y, copy, phrase = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(copy, pa.int64()), pa.array(phrase, pa.string())], names=["y", "copy", "phrase"])


def _cover(toxic: list[tuple[int, list[str]]], weights: dict[str, float], clean: dict[str, int], least: int) -> dict[str, float]:
    """Greedy covering of the toxic documents (copy key, matching words) by stems: stem -> weight."""
    left = [set(words) for _, words in toxic]
    covered = [0] * len(toxic)
    picked: dict[str, float] = {}
    while True:
        gain: dict[str, set[int]] = defaultdict(set)
        for i, (copy, _) in enumerate(toxic):
            if covered[i] < COVER:
                for s in {s for w in left[i] for s in _stems(w) if s in weights}:
                    gain[s].add(copy)
        best = max(gain, key=lambda s: (len(gain[s]) - CLEAN_COST * clean.get(s, 0), len(s), s), default=None)
        if best is None or len(gain[best]) < least:
            return picked
        picked[best] = weights[best]
        for i, d in enumerate(left):
            rest = {w for w in d if not w.startswith(best)}
            covered[i] += len(rest) < len(d)
            left[i] = rest


class Lexicon:
    """Stems with weights, exception phrases, and the rate at which the score is 0.5."""

    def __init__(self, stems: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, threshold: float = 0.05):
        self.stems, self.exceptions, self.threshold = dict(stems), tuple(exceptions), threshold
        self._machine = None

    def __getstate__(self):
        return {**self.__dict__, "_machine": None}

    @property
    def machine(self):
        if self._machine is None:
            m = ahocorasick.Automaton()
            for s, w in self.stems.items():
                m.add_word(" " + s, (len(s) + 1, w))
            for p in self.exceptions:
                p = " ".join(fold(p).split())
                if not m.exists(" " + p):
                    m.add_word(" " + p, (len(p) + 1, None))
            m.make_automaton()
            self._machine = m
        return self._machine

    def rate(self, text: str | None) -> float:
        """Sum of the weights of the words that match, over the number of words."""
        if not text or not len(self.machine):
            return 0.0
        folded = fold(text)
        words: dict[int, float] = {}                 # begin of a word -> its highest weight
        harmless: list[tuple[int, int]] = []
        for end, (n, weight) in self.machine.iter(folded):
            if weight is None:
                harmless.append((end - n + 1, end))
            else:
                words[end - n + 1] = max(weight, words.get(end - n + 1, 0.0))
        if harmless:
            words = {b: w for b, w in words.items() if not any(x <= b <= y for x, y in harmless)}
        return math.fsum(words.values()) / len(folded.split()) if words else 0.0

    def score(self, text: str | None) -> float:
        r = self.rate(text)
        return r / (r + self.threshold)


def _threshold(rates: list[tuple[float, int]], default: float) -> float:
    """The rate that separates the sample best; a quarter of the way up the gap it lies in."""
    if not any(y for _, y in rates):
        return default
    rates = sorted(rates)
    wrong = sum(1 for _, y in rates if not y)            # threshold below everything: all clean ones are wrong
    best, at = wrong, None
    for i, (r, y) in enumerate(rates):
        wrong += 1 if y else -1
        if i + 1 < len(rates) and rates[i + 1][0] == r:
            continue
        if wrong < best or at is None:
            up = rates[i + 1][0] if i + 1 < len(rates) else 2 * r
            if up > r:
                best, at = wrong, r + (up - r) / 4
    return at if at else default


def _rates(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [lexicon.rate(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column("y")], names=["rate", "y"])


def _exceptions(sample: DataFrame, stems: tuple[str, ...]) -> tuple[str, ...]:
    """Words and word pairs with a stem that clean documents have and toxic ones hardly do; pairs only where their words are none."""
    found = sample.select("text", "y").mapInArrow(partial(_phrases_with_stems, stems=stems), "y int, copy long, phrase string").distinct()
    counts = found.groupBy("phrase").agg(F.count_if(F.col("y") == 0).alias("clean"), F.count(F.lit(1)).alias("n"))
    rows = counts.where((F.col("clean") >= SUPPORT) & (F.col("clean") >= MIN_PRECISION * F.col("n"))).collect()
    harmless = {r.phrase for r in rows} - set(stems)
    return tuple(sorted(p for p in harmless if " " not in p or not harmless & set(p.split())))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Lexicon:
    """A lexicon fitted on at most ``rows`` labelled documents, none of them held out.

    Stems and phrases are counted on Spark.  The driver gets the stems that pass,
    of which there are at most 1 / ``SUPPORT_SHARE`` times those of a mean toxic
    document, the words with such stems, and the phrases that pass.
    """
    spark = bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", rows).select("text", "y")
    counted = sample.mapInArrow(_stem_counts, "y int, stem string, copy long, n long")
    # copies of a toxic document count once: their key is grouped first
    counts = stored(counted.groupBy("stem", "y", "copy").agg(F.sum("n").alias("n")).groupBy("stem").agg(
        F.count_if(F.col("y") == 1).alias("toxic"), F.coalesce(F.sum(F.when(F.col("y") == 0, F.col("n"))), F.lit(0)).alias("clean")), "stem-counts")
    n_toxic, n_clean = next(((r.toxic, r.clean) for r in counts.where("stem = ''").collect()), (0, 0))
    least = max(SUPPORT, math.ceil(SUPPORT_SHARE * n_toxic))
    precise = (F.col("toxic") >= least) & (F.col("toxic") >= MIN_PRECISION * (F.col("toxic") + F.col("clean"))) & (F.col("stem") != "")
    weights, clean = {}, {}
    for r in counts.where(precise | F.col("stem").isin(*SEED_STEMS)).collect():
        clean[r.stem] = r.clean
        weight = math.log((r.toxic + 0.5) / (n_toxic + 1)) - math.log((r.clean + 0.5) / (n_clean + 1))
        if weight >= MIN_WEIGHT and r.toxic >= least and r.toxic >= MIN_PRECISION * (r.toxic + r.clean):
            weights[r.stem] = weight
    matching = partial(_matching_words, stems=spark.sparkContext.broadcast(set(weights)))
    toxic = [(r.copy, r.words) for r in sample.where("y = 1").mapInArrow(matching, "copy long, words array<string>").collect()]
    stems = {**{s: w for s, w in SEED_STEMS.items() if not clean.get(s)}, **_cover(toxic, weights, clean, least)}
    lexicon = Lexicon(stems, (*EXCEPTIONS, *_exceptions(sample, tuple(stems))))
    rates = [(r.rate, r.y) for r in sample.mapInArrow(partial(_rates, lexicon=lexicon), "rate double, y int").collect()]
    lexicon.threshold = _threshold(rates, lexicon.threshold)
    return lexicon


def _score(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [lexicon.score(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    narrow = docs.select("doc_id", "text")
    scored = narrow.mapInArrow(partial(_score, lexicon=lexicon), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _kept(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([lexicon.score(t) < THRESHOLD for t in batch.column("text").to_pylist()], pa.bool_()))


def reject(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` without the documents that score ``THRESHOLD`` or more."""
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(partial(_kept, lexicon=lexicon), docs.schema)

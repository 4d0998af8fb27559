"""Benchmark decontamination: a broadcast set of normalised benchmark word n-grams, scanned against every document.

Words are runs of letters and digits after lower-casing A-Z (any non-ASCII
byte belongs to a word).  A benchmark item's windows are its runs of
``window`` words; an item with fewer words is one window.  A document word
inside any occurrence of a window is hit.  Window hashes select places in the
texts, and each place is then compared word by word.

The benchmark is broadcast in parts of at most ``PART_BYTES`` of text.  A part's
index is sorted hashes with places in the part's text, 16 bytes a window, and a
worker keeps ``CACHED`` of them.  One part is the usual case; a larger benchmark
is scanned part after part in one pass over the documents, each part adding to
the hits of the parts before, so memory stays bounded and nothing is shuffled.
The benchmark passes through the driver a part at a time.

Edge cases: a null or empty text has no words and no hits; items without words
are ignored; repeated items and items with the same id count once; a null
item_id counts as the id "null"; very long texts are scanned whole; empty tables give no rows or no hits; extra
columns are ignored by ``scan`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .words import ALNUM_LOWER, Slice, Words, fits, slices, windows, words

WINDOW = 10
#: Benchmark text broadcast at once, in bytes.
PART_BYTES = 16 << 20
#: Indexes of parts that a Python worker keeps: about four times their text each.
CACHED = 4
_FILTER_BITS = 22

SCANNED = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<begin:long,end:long>>"


class _Index:
    """Windows of one part of the benchmark: by length, sorted hashes with the places of their words in the part's text.

    A window costs 16 bytes besides the text, whatever its words.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.ids = [i for i, _ in items]
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.text, base = [], 0
        for s in slices(pa.array([t for _, t in items], pa.large_string())):
            w = words(s, ALNUM_LOWER)
            # the words alone, a space after each: a window's words are one run of these bytes
            kept = np.zeros(len(s.data) + 1, np.int8)
            np.add.at(kept, w.start, 1)
            np.add.at(kept, w.end, -1)
            inside = np.cumsum(kept[:-1]) > 0
            lengths = w.end - w.start
            begins = np.concatenate(([0], np.cumsum(lengths + 1)))
            packed = np.full(int(begins[-1]), 0x20, np.uint8)
            at = np.repeat(begins[:-1] - np.concatenate(([0], np.cumsum(lengths)))[:-1], lengths) + np.arange(int(lengths.sum()))
            packed[at] = ALNUM_LOWER[s.data[inside]].astype(np.uint8)
            count = np.diff(w.first)
            for k in np.unique(np.minimum(count, window)).tolist():
                if k == 0:
                    continue
                h = windows(w.hashes[0], k)
                text = w.text_of_word()[:len(h)]
                own = fits(w.first, k) & ((count[text] >= window) if k == window else (count[text] == k))
                j = np.flatnonzero(own)
                found.setdefault(k, []).append((h[j], (base + begins[j]).astype(np.int64), (s.row + text[j]).astype(np.int32)))
            self.text.append(packed)
            base += len(packed)
        self.text = np.concatenate(self.text) if self.text else np.zeros(0, np.uint8)
        self.places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.filters = {}
        for k, parts in sorted(found.items()):
            h, begin, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.places[k] = h[order], begin[order], item[order]
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[h >> np.uint64(64 - _FILTER_BITS)] = True
            self.filters[k] = seen

    def nbytes(self) -> int:
        return len(self.text) + sum(x.nbytes for p in self.places.values() for x in p)

    def hits(self, s: Slice, w: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """A flag per word of the slice, and the item ids found per text."""
        hit = np.zeros(len(w.start), bool)
        found: dict[int, set[str]] = {}
        for k, (known, begins, owners) in self.places.items():
            h = windows(w.hashes[0], k)
            if not len(h):
                continue
            at = np.flatnonzero(self.filters[k][h >> np.uint64(64 - _FILTER_BITS)] & fits(w.first, k))
            if not len(at):
                continue
            low = np.searchsorted(known, h[at])
            same = known[np.minimum(low, len(known) - 1)] == h[at]
            at, low = at[same], low[same]
            high = np.searchsorted(known, h[at], side="right")
            text = np.searchsorted(w.first, at, side="right") - 1
            for j, i, a, b in zip(at.tolist(), text.tolist(), low.tolist(), high.tolist(), strict=True):
                tokens = (s.data[x:y].tobytes() for x, y in zip(w.start[j:j + k], w.end[j:j + k], strict=True))
                run = np.frombuffer(b" ".join([*tokens, b""]).lower(), np.uint8)
                for place in range(a, b):
                    if np.array_equal(self.text[begins[place]:begins[place] + len(run)], run):
                        hit[j:j + k] = True
                        found.setdefault(i, set()).add(self.ids[owners[place]])
        return hit, found


_CACHE: dict[tuple[str, int], _Index] = {}


def _index(part: tuple, window: int) -> _Index:
    """The index of a part (its name, its broadcast), built once per worker while ``CACHED`` parts suffice."""
    key = part[0], window
    if key not in _CACHE:
        while len(_CACHE) >= CACHED:
            _CACHE.pop(next(iter(_CACHE)))
        _CACHE[key] = _Index(part[1].value, window)
    return _CACHE[key]


def _scan(batches: Iterator[pa.RecordBatch], parts: list[tuple], window: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                        ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])
    for batch in batches:
        n_words, n_hit, items, spans = [], [], [], []
        for s in slices(batch.column("text")):
            w = words(s, ALNUM_LOWER)
            hit, found = np.zeros(len(w.start), bool), {}
            for part in parts:
                h, f = _index(part, window).hits(s, w)
                hit |= h
                for i, owners in f.items():
                    found.setdefault(i, set()).update(owners)
            n_words += np.diff(w.first).tolist()
            for i in range(len(s.offsets) - 1):
                if i not in found:
                    n_hit.append(0), items.append([]), spans.append([])
                    continue
                a, b = w.first[i], w.first[i + 1]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0]))))
                n_hit.append(int(hit[a:b].sum()))
                items.append(sorted(found[i]))
                spans.append([{"begin": int(w.start[a + x] - s.offsets[i]), "end": int(w.end[a + y - 1] - s.offsets[i])}
                              for x, y in edge.reshape(-1, 2)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                                          pa.array(items, schema.field("items").type), pa.array(spans, schema.field("spans").type)], schema=schema)


def _parts(benchmark: DataFrame, part_bytes: int) -> list[tuple]:
    """The benchmark in named broadcasts of about ``part_bytes`` each (an item is never split)."""
    items = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // part_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    sc = benchmark.sparkSession.sparkContext
    return [(uuid.uuid4().hex, sc.broadcast([tuple(r) for r in items.where(part == p).collect()])) for p in range(n)]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids, sorted), spans (UTF-8 byte ranges that are hit) of every document."""
    bounded_batches(docs.sparkSession)
    work = partial(_scan, parts=_parts(benchmark, part_bytes), window=window)
    return docs.select("doc_id", "text").mapInArrow(work, SCANNED)


def _clean(batches: Iterator[pa.RecordBatch], parts: list[tuple], window: int, mode: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        narrow = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column("text")], names=["doc_id", "text"])
        found = next(_scan(iter([narrow]), parts, window))
        hit = np.asarray(found.column("n_hit"))
        if mode == "documents":
            yield batch.filter(pa.array(hit == 0))
            continue
        texts = batch.column("text").to_pylist()
        for i in np.flatnonzero(hit):
            raw, at, kept = texts[i].encode(), 0, []
            for span in found.column("spans")[int(i)].as_py():
                kept.append(raw[at:span["begin"]])
                at = span["end"]
            texts[i] = b"".join([*kept, raw[at:]]).decode()
        yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` without contaminated documents, or (mode "spans") with the hit spans cut out of their texts."""
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(partial(_clean, parts=_parts(benchmark, part_bytes), window=window, mode=mode), docs.schema)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    return scan(docs, benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

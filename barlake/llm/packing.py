"""Packing of tokenised documents into training sequences of equal cost.

Attention makes long documents dearer than short ones: a piece of n tokens
costs ``LINEAR`` n + ``QUADRATIC`` n^2 (documents are masked from each other).
Every full sequence's worth of a document is a sequence of its own; what is
left of the documents is gathered into windows of about ``WINDOW`` tokens.  In
a window the pieces are taken in descending order, each into the sequence of
lowest cost that still has room for it.  The sequences of a window are exactly
as many as its tokens fill: full ones, and for the rest one of each power of
two that the rest consists of, which needs no padding either.  A piece that
fits nowhere whole is cut: its head fills the sequence with the most room, its
tail goes on as a piece of its own.  So every sequence is full to its
capacity, and no token is padding.

Each task packs its own rows as they come, in one pass and without a shuffle;
its memory is bounded by a window and a text.  A sequence never spans tasks, so
a task that runs again after a lost executor replaces its sequences whole.
Sequence ids are the partition's number (upper bits) and a counter.

Very long texts are tokenised in slices cut between a letter and a space that
another letter follows, where the tokenizer's own rule always separates, so
the ids are those of the whole text; nothing is left out.

Edge cases: a null or empty text is the end token alone; repeated rows are
packed as often as they come; null ids are kept; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bounded_batches

CAPACITY = 1024
END_ID = 0
#: Tokens of the document rests that are packed together.
WINDOW = 1 << 20
#: Cost of a piece of n tokens: LINEAR n + QUADRATIC n^2 (a layer of width 1024 has about 12 * 1024 times the work of an attention score).
LINEAR, QUADRATIC = 12 * 1024, 1
#: Characters tokenised at once; longer texts are cut at word borders.
SLICE_CHARS = 1 << 18
_BORDER = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: All but the basic Latin, Latin-1, Latin Extended-A, Greek and Cyrillic letters, common punctuation, kana and unified ideographs.
_UNSETTLED = re.compile(r"[^\x00-\x7E\xA0-\u017F\u0391-\u03A1\u03A3-\u03C9\u0400-\u045F\u2013\u2014\u2018-\u201E\u2026\u3001\u3002\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5]")
_PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length int, sequence_cost long"


# --- tokens -----------------------------------------------------------------------

def _slices(text: str) -> Iterator[str]:
    begin = 0
    while len(text) - begin > SLICE_CHARS:
        cut = _BORDER.search(text, begin + SLICE_CHARS)
        if cut is None:
            break
        yield text[begin:cut.start()]
        begin = cut.start()
    yield text[begin:]


class _Encoder:
    """A tokenizer file in this Python worker: ids as the library ``tokenizers`` gives them.

    Strings of special tokens count as ordinary text.  ``tiktoken`` applies the
    same vocabulary several times faster.  It merges the pair whose token has the
    lowest id, where the file's rule is the order of its merges, and splits words
    by its own Unicode tables: so it is used only if the merges are in the order of
    ids, and for texts of settled scripts, whose characters have been letters,
    digits or white space in all Unicode versions concerned.
    """

    def __init__(self, path: str, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_file(path)
        self._exact.encode_special_tokens = True
        self._fast = None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [vocabulary[a + b] for a, b in merges]
        if pattern and made == sorted(set(made)) and len(made) + 256 >= len(vocabulary) - 1:
            import tiktoken

            byte = _byte_of()
            special = {x["content"] for x in json.loads(self._exact.to_str())["added_tokens"]}
            ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
            self._fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text with the end token."""
        ids: list[int] = []
        for s in _slices(text or ""):
            if self._fast is not None and len(s) <= 2 * SLICE_CHARS and _UNSETTLED.search(s) is None:
                ids += self._fast.encode_ordinary(s)
            else:
                ids += self._exact.encode_batch_fast([s], add_special_tokens=False)[0].ids
        ids.append(END_ID)
        return np.array(ids, np.uint32)


def _byte_of() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_ENCODERS: dict[tuple, _Encoder] = {}


def _encoder(path: str, pattern: str | None) -> _Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = _Encoder(path, pattern)
    return _ENCODERS[path, pattern]


# --- packing ------------------------------------------------------------------------

def cost(n: int) -> int:
    return LINEAR * n + QUADRATIC * n * n


def capacities(tokens: int, capacity: int) -> list[int]:
    """Full sequences, then the powers of two whose sum is the rest."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], list[int], list[int]]:
    """Pieces (item, start in it, length, sequence, offset), and length and cost of each sequence; they hold all items exactly."""
    sizes = capacities(sum(lengths), capacity)
    room, price = np.array(sizes, np.int64), np.zeros(len(sizes), np.int64)
    top = np.iinfo(np.int64).max
    queue = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    pieces = []
    while queue:
        n, item, start = heapq.heappop(queue)
        n = -n
        open_ = room >= n
        if open_.any():
            to, taken = int(np.where(open_, price, top).argmin()), n
        else:                                               # cut: the head fills the sequence with the most room
            most = int(room.max())
            to, taken = int(np.where(room == most, price, top).argmin()), most
            heapq.heappush(queue, (taken - n, item, start + taken))
        pieces.append((item, start, taken, to, sizes[to] - int(room[to])))
        room[to] -= taken
        price[to] += cost(taken)
    return pieces, sizes, price.tolist()


class _Packer:
    """Rows of one task -> pieces; keeps at most a window of document rests."""

    def __init__(self, capacity: int, window: int):
        self.capacity, self.window = capacity, window
        self.next = TaskContext.get().partitionId() << 40
        self.rests: list[tuple] = []                        # (key, start, ids, tokens of the document)
        self.size = 0
        self.out: list[tuple] = []
        self.out_size = 0

    def _emit(self, key, start, ids, tokens, sequence, offset, length, price) -> None:
        self.out.append((key, start, len(ids), ids.astype("<u4").tobytes(), tokens, sequence, offset, length, price))
        self.out_size += len(ids)

    def add(self, key, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self._emit(key, start, ids[start:start + self.capacity], len(ids), self.next, 0, self.capacity, cost(self.capacity))
            self.next += 1
        if whole < len(ids):
            self.rests.append((key, whole, ids[whole:].copy(), len(ids)))   # not a view of a long document
            self.size += len(ids) - whole
            if self.size >= self.window:
                self.pack()

    def pack(self) -> None:
        pieces, sizes, prices = assign([len(r[2]) for r in self.rests], self.capacity)
        for item, start, n, to, offset in pieces:
            key, begin, ids, tokens = self.rests[item]
            self._emit(key, begin + start, ids[start:start + n], tokens, self.next + to, offset, sizes[to], prices[to])
        self.next += len(sizes)
        self.rests, self.size = [], 0

    def ready(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) if self.out else [()] * len(schema)
        self.out, self.out_size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pack(batches: Iterator[pa.RecordBatch], path: str, pattern: str | None, capacity: int, window: int) -> Iterator[pa.RecordBatch]:
    packer, schema, encoder = _Packer(capacity, window), None, _encoder(path, pattern)
    names = [x.split()[0] for x in _PIECES.split(", ")]
    kinds = {"ids": pa.binary(), "sequence_length": pa.int32()}
    for batch in batches:
        key = batch.column(0)
        schema = pa.schema([pa.field(batch.schema[0].name, key.type), *(pa.field(n, kinds.get(n, pa.int64())) for n in names)])
        for k, text in zip(key.to_pylist(), batch.column(1), strict=True):
            packer.add(k, encoder.encode(text.as_py()))
            if packer.out_size >= window:
                yield packer.ready(schema)
    if schema is not None:
        packer.pack()
        yield packer.ready(schema)


def pack(docs: DataFrame, tokenizer: str, pattern: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``key``, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, sequence_length, sequence_cost.

    ``tokenizer`` is the path of a byte-level tokenizer file that every executor
    has, ``pattern`` its word pattern (without it the slower library does all the
    work); ``capacity`` must be a power of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs[key], docs[text].cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(partial(_pack, path=tokenizer, pattern=pattern, capacity=capacity, window=window), f"`{key}` {kind}, {_PIECES}")

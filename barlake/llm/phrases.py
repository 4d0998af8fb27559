"""Repeated-phrase removal: confirm recurring passages, compile sharded Aho-Corasick automata, stream all documents.

A window is ``window`` consecutive words of one document.  Its owner is the
document with the smallest doc_id in which the same words start; in every
other document the window's words are to be removed.

Rows with equal doc_id and text are one row with a count before anything else
and are expanded again at the end, so a repeated row costs a shard one text.

1. Copies.  Documents whose text equals that of a document with a smaller
   doc_id are set aside: all of their windows recur, so nothing needs finding.
2. Anchors.  Each window is represented by the smallest hash of its runs of
   ``ANCHOR`` words (equal windows have equal anchors, neighbouring windows
   mostly share one).  A shard's distinct anchors are shuffled by value, with
   two documents each at most; those of several documents recur.
3. Windows.  Only windows with a recurring anchor are hashed (128 bits) and
   shuffled by hash, at most two rows a shard; in hash order, the first
   document of a window is its owner, and the shards of the other documents
   ask the owner for it.
4. Passages.  An owner gives its text of all asked windows once, neighbouring
   ones merged to one passage (cut every ``SPAN`` windows); a join hands it to
   the shards that ask for that part of the owner.  All that is asked of one
   part, at most ``SPAN`` numbers a shard, is in one task.
5. Automata.  Each shard of documents compiles the windows of its passages
   into an Aho-Corasick automaton over words, and streams all of its documents
   through it: every occurrence, compared word by word, of a window whose owner
   has a smaller doc_id is removed.

Shards are about ``SHARD_DOCS`` documents by a hash of id and text.  Recurring
anchors and windows are found by streaming over sorted rows, in constant
memory however many documents share one.

Edge cases: null and empty texts have no words and lose none; texts shorter
than a window lose nothing; very long texts are read whole; equal doc_ids (repeated rows) don't remove words
from each other; rows with a null doc_id neither own windows nor lose words;
each text of an id with several texts is judged on its own; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .runs import RunFirsts
from .words import SPACED, WINDOW_BASES, Words, fits, slices, windows, words

WINDOW = 13
#: Words of an anchor; a window of 13 words has 8 of them.
ANCHOR = 6
SHARD_DOCS = 512
#: Windows of an owner that are asked for and answered together.
SPAN = 256
#: Rows into which a repeated row is expanded at once.
REPEATS = 4096
#: The alphabets of a word's two characters in an automaton (the vocabulary of a shard stays far below their product).
_LOW, _HIGH = 0x100, 0x10000


def _anchors(w: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every window of ``windows(hash, window)``, and whether the window stays in its text."""
    a = windows(w.hashes[0], anchor)
    span = window - anchor + 1
    n = len(w.start) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    low, have = a, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:len(low) - step], low[step:])
        have += step
    return low[:n], fits(w.first, window)


def _found(schema: pa.Schema, columns: list[list[np.ndarray]]) -> pa.Table:
    """A table from lists of array pieces, one list per column."""
    return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_ANCHORS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("shard", pa.int32())])
_RECURRING = pa.schema([("anchor", pa.int64()), ("shard", pa.int32())])
_WINDOWS = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("shard", pa.int32())])
_DISTINCT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("shard", pa.int32()), ("n_rows", pa.int64())])
_ASKED = pa.schema([("owner", pa.int64()), ("at", pa.int32()), ("shard", pa.int32()), ("asks", pa.int32())])
_PASSAGES = pa.schema([("owner", pa.int64()), ("part", pa.int32()), ("passage", pa.string())])
_LOCATED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed", pa.list_(pa.int32())), ("kept_sha256", pa.string()), ("kept", pa.string()), ("n_rows", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one row with their number."""
    for batch in batches:
        if len(batch):
            t = pa.Table.from_batches([batch]).group_by(["doc_id", "text", "shard"]).aggregate([([], "count_all")])
            yield from t.rename_columns({"count_all": "n_rows"}).select(_DISTINCT.names).cast(_DISTINCT).combine_chunks().to_batches()


def _same(text: str) -> bytes:
    """The hash by which equal texts are known."""
    return hashlib.sha256(text.encode()).digest()


def _copied(docs: pa.Table, doc_ids: list, same: list) -> set[int]:
    """The rows of ``docs`` that are among the copies given by id and hash of the text."""
    copies, ids = set(zip(doc_ids, same, strict=True)), set(doc_ids)
    texts = docs.column("text")
    return {row for row, doc in enumerate(docs.column("doc_id").to_pylist()) if doc in ids and texts[row].is_valid and (doc, _same(texts[row].as_py())) in copies}


def _first_two(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two smallest documents of each key, in order of the key."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1]))
    turn = new.copy()
    turn[1:] |= doc[1:] != doc[:-1]
    nth = np.cumsum(turn)
    nth -= nth[np.flatnonzero(new)][np.cumsum(new) - 1]
    keep = turn & (nth < 2)
    return key[keep], doc[keep]


def _distinct_anchors(docs: pa.Table, copies: pa.Table, window: int, anchor: int) -> pa.Table:
    """The anchors of a shard's documents, each with two documents at most; none of copies."""
    skip, ids = _copied(docs, copies.column("doc_id").to_pylist(), copies.column("same").to_pylist()), docs.column("doc_id").to_pylist()
    out: list[list[np.ndarray]] = [[], []]
    for s in slices(docs.column("text")):
        w = words(s, SPACED)
        low, _ = _anchors(w, window, anchor)
        for i in range(len(s.offsets) - 1):
            a, b, doc = int(w.first[i]), int(w.first[i + 1]) - window + 1, ids[s.row + i]
            if b > a and doc is not None and s.row + i not in skip:
                x = np.unique(low[a:b]).view(np.int64)
                out[0].append(x)
                out[1].append(np.full(len(x), doc))
    if not out[0]:
        return _found(_ANCHORS, [[], [], []])
    key, doc = _first_two(np.concatenate(out[0]), np.concatenate(out[1]))
    return _found(_ANCHORS, [[key], [doc], [np.full(len(key), docs.column("shard")[0].as_py())]])


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, doc_id) -> the anchors that several documents have, with each shard that has them (perhaps repeatedly)."""
    firsts = RunFirsts()
    for batch in batches:
        key, doc, shard = (np.asarray(batch.column(c)) for c in ("anchor", "doc_id", "shard"))
        if not len(key):
            continue
        first_doc, first_shard = firsts((key,), (doc, shard))
        later = doc != first_doc
        _, begin = np.unique(key[later], return_index=True)
        rows = [np.concatenate((x[later], f[later][begin])) for x, f in ((key, key), (shard, first_shard))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _RECURRING.types, strict=True)], schema=_RECURRING)


def _candidate_windows(docs: pa.Table, anchors: pa.Table, window: int, anchor: int) -> pa.Table:
    """Hashes and places of a shard's windows that have a recurring anchor; rows of ``anchors`` without one are copies."""
    out: list[list[np.ndarray]] = [[] for _ in _WINDOWS]
    recurring = anchors.filter(anchors.column("anchor").is_valid())
    if recurring.num_rows and docs.num_rows:
        key = np.unique(np.asarray(recurring.column("anchor")).view(np.uint64))
        copies = anchors.filter(anchors.column("anchor").is_null())
        skip, ids = _copied(docs, copies.column("doc_id").to_pylist(), copies.column("same").to_pylist()), docs.column("doc_id").to_pylist()
        for s in slices(docs.column("text")):
            w = words(s, SPACED, bases=2)
            low, _ = _anchors(w, window, anchor)
            at = np.searchsorted(key, low)
            hit = key[np.minimum(at, len(key) - 1)] == low
            if not hit.any():
                continue
            w1, w2 = windows(w.hashes[0], window, WINDOW_BASES[0]), windows(w.hashes[1], window, WINDOW_BASES[1])
            for i in range(len(s.offsets) - 1):
                a, b, doc = int(w.first[i]), int(w.first[i + 1]) - window + 1, ids[s.row + i]
                if b <= a or doc is None or s.row + i in skip:
                    continue
                at = np.flatnonzero(hit[a:b])
                for o, x in zip(out, (w1[a + at].view(np.int64), w2[a + at].view(np.int64), np.full(len(at), doc), at), strict=False):
                    o.append(x)
        if out[0]:
            out = [[c] for c in _two_documents(*(np.concatenate(c) for c in out[:4]))]
            out.append([np.full(len(out[0][0]), recurring.column("shard")[0].as_py())])
    return _found(_WINDOWS, out)


def _two_documents(w1: np.ndarray, w2: np.ndarray, doc: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Of each window's rows in a shard, the first places in its first two documents.

    More aren't needed: the first may be the owner's, and any later one lets the
    shard ask for the passage.  A window that very many documents share, or one
    document repeats, costs two rows a shard.
    """
    order = np.lexsort((at, doc, w2, w1))
    columns = [x[order] for x in (w1, w2, doc, at)]
    new = np.ones(len(order), bool)
    new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
    turn = new.copy()
    turn[1:] |= columns[2][1:] != columns[2][:-1]
    nth = np.cumsum(turn)
    nth -= nth[np.flatnonzero(new)][np.cumsum(new) - 1]
    keep = turn & (nth < 2)
    return [c[keep] for c in columns]


def _asked_of_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (window, doc_id, place) -> the owner's place of the window, once per asking shard (and batch)."""
    firsts = RunFirsts()
    for batch in batches:
        w1, w2, doc, at, shard = (np.asarray(batch.column(c)) for c in _WINDOWS.names)
        if not len(w1):
            continue
        owner, place, owner_shard = firsts((w1, w2), (doc, at, shard))
        later = doc != owner
        rows = np.unique(np.column_stack([x[later].astype(np.int64) for x in (owner, place, owner_shard, shard)]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(t) for c, t in zip(rows.T, _ASKED.types, strict=True)], schema=_ASKED)


def _answers(docs: pa.Table, asked: pa.Table, window: int) -> pa.Table:
    """The owners' text of the asked windows, neighbouring ones of one part of the owner merged to a passage."""
    out: dict[str, list] = {name: [] for name in _PASSAGES.names}
    if asked.num_rows and docs.num_rows:
        owner, at = (np.asarray(asked.column(c)).astype(np.int64) for c in ("owner", "at"))
        rows = np.unique(np.column_stack((owner, at)), axis=0)
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1] + 1) | (rows[1:, 1] % SPAN == 0)
        begin = np.flatnonzero(new)
        runs = np.column_stack((rows[begin], rows[np.concatenate((begin[1:], [len(rows)])) - 1, 1]))      # owner, first, last
        docs = docs.filter(pc.is_in(docs.column("doc_id"), value_set=pa.array(np.unique(owner))))
        ids = docs.column("doc_id").to_pylist()
        for s in slices(docs.column("text")):
            w = words(s, SPACED)
            for i in range(len(s.offsets) - 1):
                doc, a, b = ids[s.row + i], int(w.first[i]), int(w.first[i + 1])
                for _, first, last in runs[np.searchsorted(runs[:, 0], doc):np.searchsorted(runs[:, 0], doc, side="right")].tolist():
                    last = min(last, b - a - window)         # the rest is of another text of a repeated id
                    if first <= last:
                        out["owner"].append(doc)
                        out["part"].append(first // SPAN)
                        out["passage"].append(s.data[w.start[a + first]:w.end[a + last + window - 1]].tobytes().decode())
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), _PASSAGES.types, strict=True)], schema=_PASSAGES)


class Automaton:
    """The windows of a shard's passages, over words: finds every window that an earlier document owns.

    A word is two characters, the digits of its number to the base of the
    vocabulary's square root, from separate alphabets: matches start and end at
    words, and no node of the automaton has a child for every word.
    """

    def __init__(self, passages: list[tuple[int, str]], window: int):
        self.window = window
        split = [(owner, passage.encode().split()) for owner, passage in passages]
        ids: dict[bytes, int] = {}
        for _, tokens in split:
            for w in tokens:
                ids.setdefault(w, len(ids))
        base = math.isqrt(len(ids)) + 1
        self.codes = {w: chr(_HIGH + n // base) + chr(_LOW + n % base) for w, n in ids.items()}
        owners: dict[str, int] = {}
        for owner, tokens in split:
            code = "".join([self.codes[w] for w in tokens])
            for i in range(0, len(code) - 2 * window + 1, 2):
                key = code[i:i + 2 * window]
                have = owners.get(key)
                if have is None or owner < have:
                    owners[key] = owner
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_STRING)
        self.owners = sorted(set(owners.values()))
        place = {owner: i for i, owner in enumerate(self.owners)}
        for key, owner in owners.items():
            self.machine.add_word(key, place[owner])
        if owners:
            self.machine.make_automaton()

    def removed(self, found: list[bytes], doc_id: int) -> np.ndarray:
        """A flag per word: covered by a window owned by a document with a smaller id."""
        gone = np.zeros(len(found) + 1, np.int32)
        if self.owners and self.owners[0] < doc_id and len(found) >= self.window:
            unknown = chr(_LOW - 1) * 2
            for end, place in self.machine.iter("".join([self.codes.get(w, unknown) for w in found])):
                if self.owners[place] < doc_id:
                    word = end >> 1
                    gone[word - self.window + 1] += 1
                    gone[word + 1] -= 1
        return np.cumsum(gone[:-1]) > 0


def _stream(docs: pa.Table, passages: pa.Table, window: int, with_text: bool) -> pa.Table:
    """Every document of a shard, streamed through the shard's automaton; rows of ``passages`` without a passage are copies."""
    given = list(zip(*(passages.column(c).to_pylist() for c in ("owner", "passage", "same")), strict=True))
    copies = _copied(docs, [x[0] for x in given if x[1] is None], [x[2] for x in given if x[1] is None])
    automaton = Automaton([x[:2] for x in given if x[1] is not None], window)
    out: dict[str, list] = {name: [] for name in _LOCATED.names}
    for row, (doc, text, n_rows) in enumerate(zip(*(docs.column(c).to_pylist() for c in ("doc_id", "text", "n_rows")), strict=True)):
        found = (text or "").encode().split()          # bytes split on exactly the white space of the words
        if row in copies and len(found) >= window:
            gone = np.ones(len(found), bool)
        elif doc is None:
            gone = np.zeros(len(found), bool)
        else:
            gone = automaton.removed(found, doc)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        kept = b" ".join(found if not len(edges) else [w for w, g in zip(found, gone.tolist(), strict=True) if not g])
        for name, value in (("doc_id", doc), ("n_words", len(found)), ("removed", edges.tolist()), ("kept_sha256", hashlib.sha256(kept).hexdigest()),
                            ("kept", kept.decode() if with_text else None), ("n_rows", n_rows)):
            out[name].append(value)
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), _LOCATED.types, strict=True)], schema=_LOCATED)


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_docs: int = SHARD_DOCS, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, removed (begin and end word of each removed passage), kept_sha256, kept of every document.

    ``kept`` is the text without the repeated passages, its words joined by one
    space (null without ``with_text``).
    """
    if not 0 < anchor <= window:
        raise ValueError("an anchor has 1 to window words")
    bounded_batches(docs.sparkSession)
    shards = max(1, -(-docs.count() // shard_docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))

    # equal rows become one: first within batches, so that few of a row are dealt out, then within shards
    distinct = texts.mapInArrow(_fewer, _ddl(_DISTINCT)).repartition("shard").groupBy("shard", "doc_id", "text").agg(F.sum("n_rows").alias("n_rows"))

    whole = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "shard", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("same")).distinct()
    firsts = whole.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(F.col("same").alias("_same"), "first")
    copies = whole.join(firsts, F.col("same") == F.col("_same")).where(F.col("doc_id") > F.col("first")).select("doc_id", "shard", "same")

    def by_shard(other: DataFrame, key: str, work, schema: pa.Schema, **settings) -> DataFrame:
        """A shard's documents with its rows of ``other``; all shards' documents are dealt out once, as the exchange is reused."""
        return distinct.groupBy("shard").cogroup(other.select(*[F.col(c).alias(c) for c in other.columns]).groupBy(key)).applyInArrow(partial(work, **settings), _ddl(schema))

    anchors = by_shard(copies, "shard", _distinct_anchors, _ANCHORS, window=window, anchor=anchor)
    recurring = anchors.repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(_recurring, _ddl(_RECURRING))
    none = F.lit(None)
    recurring = recurring.select("anchor", none.cast("long").alias("doc_id"), "shard", none.cast("binary").alias("same"))
    recurring = recurring.unionAll(copies.select(none.cast("long").alias("anchor"), "doc_id", "shard", "same"))
    candidates = by_shard(recurring, "shard", _candidate_windows, _WINDOWS, window=window, anchor=anchor)
    asked = candidates.repartition("w1", "w2").sortWithinPartitions("w1", "w2", "doc_id", "at").mapInArrow(_asked_of_owners, _ddl(_ASKED))
    # used twice, by one exchange: all is one query, or the documents would be dealt out again for the second half
    asked = asked.withColumn("part", F.floor(F.col("at") / SPAN).cast("int")).repartition("owner", "part")
    answers = by_shard(asked.select("owner", "part", "at", "shard").distinct(), "shard", _answers, _PASSAGES, window=window)
    asking = asked.select("owner", "part", "asks").distinct()
    passages = asking.join(answers, ["owner", "part"]).select("asks", "owner", "passage", none.cast("binary").alias("same"))
    passages = passages.unionAll(copies.select(F.col("shard").alias("asks"), F.col("doc_id").alias("owner"), none.cast("string").alias("passage"), "same"))
    located = by_shard(passages, "asks", _stream, _LOCATED, window=window, with_text=with_text)
    begin_end = F.transform(F.sequence(F.lit(0), (F.size("removed") / 2).cast("int") - 1), lambda i: F.struct(F.get("removed", 2 * i).alias("begin"), F.get("removed", 2 * i + 1).alias("end")))
    spans = F.when(F.size("removed") > 0, begin_end).otherwise(F.array().cast("array<struct<begin:int,end:int>>"))
    gone = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    # in two steps, as the repeats of one row may be too many for an array
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_rows") - 1) / REPEATS)))
    located = located.withColumn("_part", each).withColumn("_rows", F.least(F.lit(REPEATS).cast("long"), F.col("n_rows") - F.col("_part") * REPEATS))
    located = located.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    return located.select("doc_id", "n_words", gone.alias("n_removed"), spans.alias("removed"), "kept_sha256", "kept")

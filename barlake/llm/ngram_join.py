"""N-gram Jaccard join by parity sketches: near-duplicate classes of documents.

A document's set holds the hashes of its distinct word shingles.  Two sets
with Jaccard similarity of at least ``num / den`` differ in at most
D = (den - num) / (den + num) * (their sizes together) shingles.  Sizes are
cut into bands so that linked sets lie in one band or in neighbouring ones; in
each of the two bands a set may meet its partners, its shingles are dealt over
somewhat more than D parts and the hashes in a part are XORed.  Every shingle in
which two sets differ touches one part only, so some parts of linked sets agree
(pigeonhole).  Empty parts are no evidence: there are enough parts that a part
with shingles agrees too, and the few sets with too many empty ones keep these.

Sets that have a part in common meet there.  Parts with the same members are
one meeting, so sets that share many parts meet once.  In a meeting sets are
compared as bit sketches: each shingle flips one bit, so the Hamming distance
is never above the number of shingles in which two sets differ.  Links are
found in two steps, so that a group of near copies never gives all its pairs:

1. a spanning forest of the pairs whose sketches allow a link is verified by
   exact intersection of the sets; what is linked becomes classes;
2. all other pairs whose sketches allow a link and whose sets are still in
   different classes are verified too.

Classes are connected components of all verified links.  A large meeting is cut
into blocks, and each pair of blocks is a task of its own.  Only the sets of
possible links are ever moved, and each pair is one row, so memory is bounded
by the sketches of two blocks and by two sets, whatever the texts' lengths.

Documents with equal sets are collapsed before all of this, so a group of
copies costs one set, whatever its size; no pairs are ever emitted for it.

Edge cases: documents without words or text have no set and are linked with
nothing; with fewer words than a shingle, the whole sequence is the one
shingle; very long texts are read whole; repeated rows share their class; rows
with a null doc_id get the class of an equal set that has an id, else null; of
an id with several texts each text's links count; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, bounded_batches, stored
from .components import components
from .words import SPACED_LOWER, Slice, mixed, slices, windows, words

#: Lanes of 64 bits of a bit sketch.
LEAST_LANES, MOST_LANES = 8, 1024
#: Sets of a meeting that are compared in one task; a larger meeting is cut into blocks.
BLOCK = 2048
#: A meeting of up to so many sets is named by its members, a larger one by its part.
NAMED = 1 << 16
#: One more part for each so many that linked sets may differ in.
SPARE = 16


def shingle_sets(s: Slice, k: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles of k words."""
    w = words(s, SPACED_LOWER)
    h = w.hashes[0]
    full = windows(h, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(full[a:b - k + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        else:
            out.append(windows(h[a:b], b - a) if b > a else full[:0])
    return out


def set_hashes(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set of hashes."""
    if not len(x):
        return 0, 0
    return int(mixed(x).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mixed(x ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64))


class Bands:
    """Size bands of a similarity num/den: linked sizes lie in one band or in neighbouring ones."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]                                 # first size of each band, extended as sizes are met

    def _extend(self) -> None:
        self.low.append(self.low[-1] * self.den // self.num + 1)

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self._extend()
        return bisect.bisect_right(self.low, n) - 1

    def most_apart(self, band: int) -> int:
        """Shingles in which two linked sets that meet in this band can differ."""
        while len(self.low) <= band + 1:
            self._extend()
        return 2 * (self.low[band + 1] - 1) * (self.den - self.num) // (self.den + self.num)


def part_keys(x: np.ndarray, bands: Bands) -> np.ndarray:
    """Join keys of a set: a hash of (band, part, XOR of the part's hashes) for both bands in which it may meet its partners.

    At least as many parts agree between linked sets as there are parts beyond
    ``most_apart``; with fewer empty parts than that, one that agrees is not empty.
    """
    keys = []
    own = bands.of(len(x))
    for band in (own, own + 1):
        apart = bands.most_apart(band)
        if apart == 0:
            continue                                   # only equal sets are linked, and those are collapsed
        parts = apart + 2 + apart // SPARE
        at = ((x >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        value = np.zeros(parts, np.uint64)
        np.bitwise_xor.at(value, at.astype(np.int64), mixed(x))
        used = np.bincount(at.astype(np.int64), minlength=parts) > 0
        salt = np.arange(parts, dtype=np.uint64) + np.uint64(band << 32)
        key = mixed(value ^ mixed(salt * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
        keys.append(key[used] if (~used).sum() < parts - apart else key)
    return np.concatenate(keys) if keys else x[:0]


def bit_sketch(x: np.ndarray) -> np.ndarray:
    """One bit per shingle flipped in an array of 64-bit lanes; a power of two of them, about a bit per shingle.

    XORing its halves gives the sketch of half the lanes, so sketches of
    different lengths can be compared.
    """
    lanes = LEAST_LANES
    while lanes * 64 < len(x) and lanes < MOST_LANES:
        lanes *= 2
    out = np.zeros(lanes, np.uint64)
    np.bitwise_xor.at(out, ((x >> np.uint64(6)) & np.uint64(lanes - 1)).astype(np.int64), np.uint64(1) << (x & np.uint64(63)))
    return out


def _identify(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Size, hashes and bit sketch of each document's set."""
    for batch in batches:
        n, h1, h2, sketch = [], [], [], []
        for s in slices(batch.column("text")):
            for x in shingle_sets(s, k):
                a, b = set_hashes(x)
                n.append(len(x)), h1.append(a), h2.append(b), sketch.append(bit_sketch(x).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(c, pa.int64()) for c in (n, h1, h2)), pa.array(sketch, pa.binary())],
                                         names=["doc_id", "text_hash", "n_shingles", "h1", "h2", "sketch"])


def _parts(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(part, node) of every set, a node being a set's first hash; equal sets that a task meets again are left out."""
    bands, seen = Bands(num, den), set()
    for batch in batches:
        for s in slices(batch.column("text")):
            parts, nodes = [], []
            for x in shingle_sets(s, k):
                node = set_hashes(x)[0]
                if len(x) and node not in seen:
                    seen.add(node)
                    parts.append(part_keys(x, bands))
                    nodes.append(np.full(len(parts[-1]), node))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.concatenate(nodes), pa.int64())], names=["part", "node"])


def _named_meetings(part: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """Whole runs of (part, node) -> (meeting, node) of the parts that several sets have; equal member lists count once."""
    begin = np.flatnonzero(np.concatenate((np.ones(min(len(part), 1), bool), part[1:] != part[:-1])))
    size = np.diff(np.append(begin, len(part)))
    name = (np.add.reduceat(mixed(node.view(np.uint64)), begin) ^ mixed(size.astype(np.uint64))) if len(begin) else np.zeros(0, np.uint64)
    several = np.flatnonzero(size > 1)
    _, once = np.unique(name[several], return_index=True)
    runs = several[once]
    at = np.repeat(begin[runs] - np.cumsum(size[runs]) + size[runs], size[runs]) + np.arange(int(size[runs].sum()))
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(name[runs], size[runs]).view(np.int64), pa.int64()), pa.array(node[at], pa.int64())], names=["meeting", "node"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, node) -> (meeting, node); holds the rows of one part, up to ``NAMED`` of them."""
    none = np.zeros(0, np.int64)
    held, large = (none, none), None

    def unnamed(part: int, nodes: np.ndarray) -> pa.RecordBatch:
        name = mixed(np.array([part], np.int64).view(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(name, len(nodes)), pa.int64()), pa.array(nodes, pa.int64())], names=["meeting", "node"])

    for batch in batches:
        part, node = np.asarray(batch.column("part")), np.asarray(batch.column("node"))
        if large is not None:
            more = int((part == large).sum())
            yield unnamed(large, node[:more])
            part, node = part[more:], node[more:]
            large = large if not len(part) else None
        if not len(part):
            continue
        part, node = np.concatenate((held[0], part)), np.concatenate((held[1], node))
        fresh = np.concatenate(([True], (part[1:] != part[:-1]) | (node[1:] != node[:-1])))
        part, node = part[fresh], node[fresh]
        last = int(np.flatnonzero(part == part[-1])[0])
        yield _named_meetings(part[:last], node[:last])
        held = part[last:], node[last:]
        if len(held[0]) > NAMED:
            large = int(held[0][0])
            yield unnamed(large, held[1])
            held = none, none
    yield _named_meetings(*held)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of equal keys of sorted rows, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        key = np.column_stack([np.asarray(batch.column(c)).astype(np.int64) for c in keys])
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tuple(key[a]) != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(key[a])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def sketch_pairs(n: np.ndarray, sketches: list[np.ndarray], block: np.ndarray, label: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set i (they rise in size), the later sets of another label whose sketches allow a link with it.

    If there are two blocks, only pairs of both count.  Labels may change meanwhile.
    """
    both = len(set(block.tolist())) > 1
    lanes = np.array([len(x) for x in sketches])
    # sketches rise in lanes with the size: per length, all those at least so long, folded to it
    folded: dict[int, tuple[int, np.ndarray]] = {}
    for length in sorted(set(lanes.tolist()), reverse=True):
        begin = int(np.searchsorted(lanes, length))
        folded[length] = begin, np.array([np.bitwise_xor.reduce(x.reshape(-1, length), axis=0) for x in sketches[begin:]])
    stops = np.searchsorted(n, n * den // num, side="right")
    for i, stop in enumerate(stops.tolist()):
        at = i + 1 + np.flatnonzero((label[i + 1:stop] != label[i]) & ((block[i + 1:stop] != block[i]) if both else True))
        if len(at):
            begin, matrix = folded[int(lanes[i])]
            apart = np.bitwise_count(matrix[at - begin] ^ matrix[i - begin]).sum(axis=1, dtype=np.int64)
            yield i, at[apart * (den + num) <= (n[at] + n[i]) * (den - num)]


def sketch_forest(n: np.ndarray, sketches: list[np.ndarray], block: np.ndarray, num: int, den: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the pairs whose sketches allow a link, and each set's tree (its first set)."""
    tree, edges = np.arange(len(n)), []
    for i, near in sketch_pairs(n, sketches, block, tree, num, den):
        for j in near.tolist():
            if tree[j] != tree[i]:
                edges.append((i, j))
                low, high = sorted((tree[i], tree[j]))
                tree[tree == high] = low
    return edges, tree


_GROUP = ("group", "block", "n_shingles", "node", "sketch")


def _columns(t: pa.Table) -> tuple:
    sketches = [np.frombuffer(x, np.uint64) for x in t.column("sketch").to_pylist()]
    return np.asarray(t.column("n_shingles")), sketches, np.asarray(t.column("block")), np.asarray(t.column("node"))


_FOREST = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("group", pa.int64()), ("block", pa.int32()), ("n_shingles", pa.int64()), ("sketch", pa.binary())])


def _forests(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (group, n_shingles, node), so that forests of many groups have the same hubs -> the forest's pairs (a, b), and the members (a, null, ...) of trees of three and more.

    In a tree of two the one pair is all there is to verify.
    """
    out: list[tuple] = []
    for t in _groups(batches, ("group",)):
        n, sketches, block, node = _columns(t)
        edges, tree = sketch_forest(n, sketches, block, num, den)
        out += [(int(node[i]), int(node[j]), None, None, None, None) for i, j in edges]
        if len(edges) > 1:
            group = t.column("group")[0].as_py()
            for i in np.flatnonzero(np.bincount(tree, minlength=len(n))[tree] > 2).tolist():
                out.append((int(node[i]), None, group, int(block[i]), int(n[i]), sketches[i].tobytes()))
        if len(out) >= BATCH_ROWS:
            yield _batch(out, _FOREST)
            out = []
    yield _batch(out, _FOREST)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _across(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (group, n_shingles, node), each with its class -> all pairs of different classes whose sketches allow a link."""
    out: list[tuple] = []
    for t in _groups(batches, ("group",)):
        label = np.asarray(t.column("class"))
        if (label == label[0]).all():
            continue
        n, sketches, block, node = _columns(t)
        for i, near in sketch_pairs(n, sketches, block, label, num, den):
            out += [(int(node[i]), int(node[j])) for j in near.tolist()]
            if len(out) >= BATCH_ROWS:
                yield _batch(out, _PAIRS)
                out = []
    yield _batch(out, _PAIRS)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The set of each text that is the wanted one of its id."""
    for batch in batches:
        want = batch.column("node").to_pylist(), batch.column("h2").to_pylist()
        row, nodes, raw = 0, [], []
        for s in slices(batch.column("text")):
            for x in shingle_sets(s, k):
                if set_hashes(x) == (want[0][row], want[1][row]):              # else another text of a repeated id
                    nodes.append(want[0][row])
                    raw.append(x.tobytes())
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(raw, pa.binary())], names=["node", "shingles"])
            nodes, raw = [], []


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets are linked, by exact intersection."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return den * common >= num * (len(a) + len(b) - common)


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs with both sets -> the pairs that are linked."""
    for batch in batches:
        sets = zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)
        keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in sets]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(partial(_verify, num=num, den=den), "a long, b long")


def _in_groups(meetings: DataFrame) -> DataFrame:
    """(group, block, node): the pairs of blocks of each meeting, with the members of both."""
    sizes = (meetings.groupBy("meeting").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
             .select(F.col("meeting").alias("_meeting"), "blocks"))
    rows = meetings.join(sizes, F.col("meeting") == F.col("_meeting")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    one = rows.where("blocks = 1").select(F.col("meeting").alias("group"), "block", "node")
    many = rows.where("blocks > 1").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select(F.xxhash64("meeting", F.least("block", "_other"), F.greatest("block", "_other")).alias("group"), "block", "node")
    return one.unionByName(many)


def _links(texts: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n_shingles, h1, h2, sketch), one row per set, and the verified links (a, b) between sets, named by h1."""
    narrow = texts.mapInArrow(partial(_identify, k=k), "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, sketch binary")
    narrow = stored(narrow, "shingle-sets")
    # one row a set, however often its rows are repeated; equal sets have equal sketches
    one_each = (narrow.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
                .groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("first_id"), F.first("sketch").alias("sketch")))

    parts = texts.select("text").mapInArrow(partial(_parts, k=k, num=num, den=den), "part long, node long")
    met = parts.repartition("part").sortWithinPartitions("part", "node").mapInArrow(_meet, "meeting long, node long")
    groups = _in_groups(stored(met.distinct(), "meetings"))
    nodes = one_each.select(F.col("h1").alias("node"), "n_shingles", "sketch")
    members = groups.join(nodes, "node").select(*_GROUP).repartition("group").sortWithinPartitions("group", "n_shingles", "node")
    forest = stored(members.mapInArrow(partial(_forests, num=num, den=den), "a long, b long, group long, block int, n_shingles long, sketch binary"), "sketch-forests")

    pairs = stored(forest.where(F.col("b").isNotNull()).select("a", "b").distinct(), "possible-links")
    possible = pairs.select(F.col("a").alias("h1")).unionAll(pairs.select(F.col("b").alias("h1"))).distinct()
    wanted = one_each.join(possible, "h1").select(F.col("first_id").alias("_id"), F.col("h1").alias("node"), "h2")
    # repeated rows are one row before texts meet the sets, so a hot doc_id is not moved more than once
    distinct = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).dropDuplicates(["doc_id", "text"])
    sets = distinct.join(wanted, F.col("doc_id") == F.col("_id")).select("node", "h2", "text").mapInArrow(partial(_sets, k=k), "node long, shingles binary")
    sets = stored(sets.dropDuplicates(["node"]), "sets-of-possible-links")

    links = stored(_verified(pairs, sets, num, den), "links")
    joined = stored(components(links), "classes-so-far").select(F.col("node").alias("_node"), "component")
    rest = forest.where(F.col("b").isNull()).select("group", "block", "n_shingles", F.col("a").alias("node"), "sketch")
    rest = rest.join(joined, F.col("node") == F.col("_node"), "left").select(*_GROUP, F.coalesce("component", "node").alias("class"))
    rest = rest.repartition("group").sortWithinPartitions("group", "n_shingles", "node").mapInArrow(partial(_across, num=num, den=den), "a long, b long")
    return narrow, one_each, stored(links.unionByName(_verified(rest.distinct().join(pairs, ["a", "b"], "left_anti"), sets, num, den)), "links")


def _texts(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_hash(docs))


def _text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"]).alias("text_hash")


def near_duplicates(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; ``docs`` has doc_id and text."""
    narrow, one_each, links = _links(_texts(docs), k, num, den)
    first = one_each.select(F.col("h1").alias("node"), "first_id")
    ends = links.join(first.toDF("a", "u"), "a").join(first.toDF("b", "v"), "b").select("u", "v")
    found = components(ends)
    labelled = (one_each.join(found, F.col("first_id") == F.col("node"), "left")
                .select(F.col("n_shingles").alias("_n"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.coalesce("component", "first_id").alias("_class")))
    return (narrow.join(labelled, (F.col("n_shingles") == F.col("_n")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
            .select("doc_id", "n_shingles", F.coalesce("_class", "doc_id").alias("component_id")))


def keep_one(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``docs`` with one document of each class of texts: the one with the smallest (doc_id, hash of the text).

    An id with several texts stays with those that are the first of their class.
    Without words or text, one row of each id stays; of rows that are equal in id
    and text, the least by a hash of the row; rows with a null doc_id all stay.
    The choice doesn't depend on the order of rows.
    """
    narrow, _, links = _links(_texts(docs), k, num, den)
    found = components(links).select(F.col("node").alias("_node"), "component")
    rows = narrow.where(F.col("doc_id").isNotNull()).join(found, F.col("h1") == F.col("_node"), "left")
    empty = F.col("n_shingles") == 0
    rows = rows.select("doc_id", "text_hash", empty.alias("_empty"), F.when(empty, F.col("doc_id")).otherwise(F.coalesce("component", "h1")).alias("_class"))
    kept = rows.groupBy("_empty", "_class").agg(F.min(F.struct("doc_id", "text_hash")).alias("_k")).select("_k.*").distinct()
    comparable = [docs[f.name] for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    chosen = docs.select(F.struct(*docs.columns).alias("_row"), docs["doc_id"].cast("long").alias("_id"), _text_hash(docs), F.xxhash64(*comparable).alias("_order"))
    chosen = (chosen.join(kept, (F.col("_id") == kept["doc_id"]) & (chosen["text_hash"] == kept["text_hash"]), "left_semi")
              .groupBy("_id", "text_hash").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*"))
    return chosen.unionAll(docs.where(F.col("doc_id").isNull()))

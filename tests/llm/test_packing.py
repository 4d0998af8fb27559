import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from barlake.llm import packing as P
from barlake.llm.queries import TOKENIZER, tokenizer_path, tokenizer_pattern
from helpers import awkward_texts

SCHEMA = "doc_id long, text string, length int, ids string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    t.encode_special_tokens = True
    return t


def _texts():
    rng = random.Random(3)
    words = ["the", "Straße", "данные", "数据", "x1", "naïve", "it's", "--", "\n\n", "🙂", "<|endoftext|>", "  "]
    rows = [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 900)))) for i in range(60)]
    return rows + awkward_texts()


def _greedy(lengths, capacity):
    """The rule on plain lists: descending pieces, lowest cost with room, else cut into the sequence with the most room."""
    total = sum(lengths)
    sizes = [capacity] * (total // capacity) + [2 ** b for b in range(20, -1, -1) if (total % capacity) & 2 ** b]
    room, price, queue, out = list(sizes), [0] * len(sizes), [(n, i, 0) for i, n in enumerate(lengths) if n], []
    while queue:
        queue.sort(key=lambda x: (-x[0], x[1], x[2]))
        n, i, start = queue.pop(0)
        fit = [s for s in range(len(sizes)) if room[s] >= n]
        if fit:
            s = min(fit, key=lambda s: (price[s], s))
        else:
            s = min(range(len(sizes)), key=lambda s: (-room[s], price[s], s))
            queue.append((n - room[s], i, start + room[s]))
            n = room[s]
        out.append((i, start, n, s, sizes[s] - room[s]))
        room[s] -= n
        price[s] += 12 * 1024 * n + n * n
    return out, sizes, price


@pytest.mark.parametrize("seed", range(6))
def test_assignment_follows_the_rule(seed):
    rng = random.Random(seed)
    lengths = [rng.choice((1, 7, 7, rng.randrange(1, 128), rng.randrange(1, 40))) for _ in range(rng.randrange(1, 300))]
    assert P.assign(lengths, 128) == _greedy(lengths, 128)


def test_costs_are_balanced():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 600) for _ in range(2000)]
    _, sizes, price = P.assign(lengths, 1024)
    full = [p for p, n in zip(price, sizes) if n == 1024]
    in_order, room = [0], 1024
    for n in lengths:                                              # packing in order of arrival, for comparison
        while n:
            taken = min(n, room)
            in_order[-1] += P.cost(taken)
            n, room = n - taken, room - taken
            if not room:
                in_order.append(0)
                room = 1024
    assert np.std(full) < 0.5 * np.std(in_order[:-1])


@pytest.mark.parametrize("pattern", [None, tokenizer_pattern()])
def test_both_libraries_give_the_same_ids(tokenizer, pattern):
    encoder = P._Encoder(tokenizer_path(TOKENIZER), pattern)
    assert (encoder._fast is not None) == bool(pattern)
    settled = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not P._UNSETTLED.match(chr(c))]
    assert len(settled) > 21_000
    texts = [f"a{c} {c}1{c}{c}  {c}\n{c}'s" for c in settled] + [t for _, t in _texts()]
    rng = random.Random(9)
    texts += ["".join(rng.choice(settled[:900]) for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    texts += ["".join(rng.choice("ab c\t\n 'st12.é") for _ in range(200)) for _ in range(300)] + [" " * 3000, "x" * 600_000, "ab " * 300_000]
    for text in texts:
        assert encoder.encode(text).tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("window,partitions,slice_chars", [(P.WINDOW, 1, P.SLICE_CHARS), (3000, 4, 700)])
def test_pieces_hold_every_id_once(spark, monkeypatch, tokenizer, window, partitions, slice_chars):
    monkeypatch.setattr(P, "SLICE_CHARS", slice_chars)
    rows = _texts()
    docs = spark.createDataFrame([(i, t, 5, "own") for i, t in rows], SCHEMA).repartition(partitions)
    got = P.pack(docs, tokenizer_path(TOKENIZER), tokenizer_pattern(), window=window).collect()
    assert got[0].__fields__ == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length", "sequence_cost"]

    want = defaultdict(int)
    for i, t in rows:
        want[i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_length"], r["sequence_cost"]))
    for (i, ids), copies in want.items():
        mine = [p for p in pieces[i, len(ids)] if tuple(p[1]) == ids[p[0]:p[0] + len(p[1])]]
        covered = np.zeros(len(ids), int)
        for start, part in mine:
            covered[start:start + len(part)] += 1
        assert (covered == copies).all()
    assert sum(r["length"] for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    for parts in sequences.values():
        at = 0
        for offset, n, _, _ in sorted(parts):
            assert offset == at
            at += n
        assert {p[2] for p in parts} == {at} and at <= 1024 and at & (at - 1) == 0   # full to the capacity, or a power of two: no padding
        assert {p[3] for p in parts} == {sum(P.cost(p[1]) for p in parts)}


def test_query_gives_checksums_of_the_ids(spark, sf_dir):
    from barlake.llm import queries
    rows = queries.op12_cost_balanced_packing(spark, sf_dir)
    assert rows.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    real = P.pack(queries.table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), tokenizer_pattern()).collect()
    want = {(r["doc_id"], r["start"], zlib.crc32(r["ids"]), r["sequence_id"], r["offset"]) for r in real}
    assert {(r["doc_id"], r["start"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in rows.collect()} == want


def test_empty_table_and_odd_capacity(spark):
    assert P.pack(spark.createDataFrame([], SCHEMA), tokenizer_path(TOKENIZER)).collect() == []
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([], SCHEMA), tokenizer_path(TOKENIZER), capacity=1000)

import numpy as np
import pyarrow as pa
from helpers import ALNUM, LOWER, SPACED, awkward_texts

from barlake.llm import words as W
from barlake.llm.runs import RunFirsts

TEXTS = [t for _, t in awkward_texts()] + ["é1 Ünïcode—dash", "a\x00b c", "12-34 A_b"]


def test_words_are_those_of_the_patterns():
    for table, pattern, fold in ((W.SPACED, SPACED, False), (W.SPACED_LOWER, SPACED, True), (W.ALNUM_LOWER, ALNUM, True)):
        for target in (1, 64, 1 << 20):
            got = []
            for s in W.slices(pa.array(TEXTS, pa.string()), target):
                w = W.words(s, table)
                raw = s.data.tobytes()
                for a, b in zip(w.first[:-1], w.first[1:]):
                    got.append([raw[x:y].decode() for x, y in zip(w.start[a:b], w.end[a:b])])
            want = [pattern.findall((t or "").translate(LOWER) if fold else t or "") for t in TEXTS]
            assert [[x.translate(LOWER) for x in g] if fold else g for g in got] == want


def test_equal_words_and_windows_have_equal_hashes_wherever_they_are():
    texts = ["p q r s", "", "x p q r", "P q R s"]
    s, = W.slices(pa.array(texts))
    w = W.words(s, W.SPACED_LOWER, bases=2)
    for h in w.hashes:
        assert h[0] == h[5] == h[8] and len(set(h[:4].tolist())) == 4
        win, ok = W.windows(h, 3), W.fits(w.first, 3)
        assert win[0] == win[5] == win[8] and ok.tolist() == [True, True, False, False, True, True, False, False, True, True]


def test_sliced_arrow_columns_keep_their_rows():
    column = pa.array(["zero", None, "one two", "", "three"])[1:4]
    got = [(s.row + i, int(b - a)) for s in W.slices(column) for w in [W.words(s, W.SPACED)] for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:]))]
    assert got == [(0, 0), (1, 2), (2, 0)] and list(W.slices(pa.array([], pa.string()))) == []


def test_run_firsts_carry_over_batches():
    key = np.array([1, 1, 1, 2, 3, 3, 3, 3]), np.array([5, 5, 6, 6, 6, 6, 6, 7])
    value = np.arange(8)
    want = [0, 0, 2, 3, 4, 4, 4, 7]
    for cuts in ([8], [1] * 8, [2, 3, 3], [5, 3]):
        firsts, at, got = RunFirsts(), 0, []
        for n in cuts:
            got += firsts(tuple(k[at:at + n] for k in key), (value[at:at + n],))[0].tolist()
            at += n
        assert got == want

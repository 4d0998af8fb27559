import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from barlake.llm import vector_codes as V


def _brute(rows, parts=16, entries=64, rounds=2):
    """Plain distances in Python integers; rows of (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * Fraction(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    d = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    kept = [(i, v + [0] * (parts * d - len(v)), label) for i, v, label in kept]
    seeds = {}
    for i, v, _ in sorted(kept, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        seeds.setdefault(i, v)
    seeds = list(seeds.values())[:entries]
    books = [[s[j * d:(j + 1) * d] for s in seeds] for j in range(parts)]

    def assign(v):
        code, error = [], 0
        for j in range(parts):
            x = v[j * d:(j + 1) * d]
            dist = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[j]]
            code.append(dist.index(min(dist)))
            error += min(dist)
        return code, error

    for _ in range(rounds):
        codes = [assign(v)[0] for _, v, _ in kept]
        for j in range(parts):
            for k in range(len(seeds)):
                own = [v[j * d:(j + 1) * d] for (_, v, _), c in zip(kept, codes) if c[j] == k]
                if own:
                    books[j][k] = [sum(c) // len(own) for c in zip(*own)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [(i, *assign(v), label) for i, v, label in kept]
    by_label = {}
    for _, _, e, label in found:
        by_label[label] = by_label.get(label, 0) + e
    return sorted((str(i), bytes(c).hex(), e, by_label[label], sha) for i, c, e, label in found)


def _rows(n, d, seed=0, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(d)] for _ in range(9)]
    return [(i, [x + rng.gauss(0, 0.1 * scale) for x in centres[i % 9]], (None, 1, 2)[i % 3]) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "own") for r in rows], "vec_id long, embedding array<double>, label int, error int, code string").repartition(3)


def _result(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in map(tuple, df.collect()))


@pytest.mark.parametrize("d", [16, 64, 80, 40])
def test_matches_brute_force(spark, d):
    rows = _rows(150, d, seed=d)
    rows += [(500, None, 1), (501, [1.0, None] * (d // 2), 1), (502, [float("nan")] * d, 2), (503, [float("-inf")] * d, None), (504, [], 1), (505, [0.5] * (d - 3), 2),
             (3, rows[3][1], 1), (4, [9.0] * d, 1), (None, [0.1] * d, None), (None, [0.2] * d, None)]
    assert _result(V.compress(_frame(spark, rows))) == _brute(rows)


def test_few_vectors_ties_and_no_vectors(spark):
    same = [(i, [0.25] * 32, 1) for i in range(90)]                                   # all entries equal: index 0
    assert _result(V.compress(_frame(spark, same))) == _brute(same) and {r[1] for r in _brute(same)} == {"00" * 16}
    few = _rows(5, 32)
    assert _result(V.compress(_frame(spark, few))) == _brute(few)
    assert V.compress(_frame(spark, [(1, None, 1)])).collect() == []
    empty = [(1, [], 1), (2, [], 2)]
    assert _result(V.compress(_frame(spark, empty))) == _brute(empty)


def test_large_components_are_exact(spark):
    rows = _rows(80, 32, scale=3.0e6) + [(900, [2.0 ** 40 + 0.5] * 32, 1), (901, [-(2.0 ** 33)] * 32, 1)]
    assert max(abs(x) for _, v, _ in rows for x in v) < 1 << 53
    _check_against_brute(spark, rows)


def test_components_of_any_size_take_part(spark):
    """Beyond 64 bits, at the edge of the doubles, and as seeds: nothing that is finite is left out."""
    huge = [(900, [1.0e18] * 32, 1), (901, [-1.0e300] * 31 + [0.3], 2), (902, [1.7e308] * 32, None), (903, [1.7e308] * 32, None), (904, [2.0 ** 54, -0.001] * 16, 4)]
    _check_against_brute(spark, _rows(80, 32) + huge)
    _check_against_brute(spark, [(i - 1000, v, label) for i, v, label in huge] + _rows(80, 32))


def test_limbs_add_up():
    for total in (0, -1, 1, 1 << 62, -(1 << 62), (1 << 62) - 1, 3 ** 500, -(3 ** 500)):
        assert sum(x << V.BITS * i for i, x in enumerate(V.limbs(total))) == total
        assert all(-(1 << 63) <= x < 1 << 63 for x in V.limbs(total))


def _check_against_brute(spark, rows):
    got = {r[0]: r for r in _result(V.compress(_frame(spark, rows)))}
    for want in _brute(rows):
        fits = [x if x < 1 << 63 else None for x in want[2:4]]
        assert got[want[0]] == (want[0], want[1], *fits, want[4])


def test_transform_keeps_distances_and_orders_by_sign_changes():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 4, 7, 16, 33):
        p = 1 << (d - 1).bit_length()
        x, y = rng.integers(-1000, 1000, (2, 5, d))
        assert (((V.transform(x) - V.transform(y)) ** 2).sum(axis=1) == p * ((x - y) ** 2).sum(axis=1)).all()
        rows = V.transform(np.eye(p, dtype=np.int64)).T
        assert [int((np.diff(r) != 0).sum()) for r in rows] == list(range(p))


@pytest.mark.parametrize("seed", range(4))
def test_elimination_finds_the_lowest_nearest_entry(seed):
    rng = np.random.default_rng(seed)
    for d, k, top in ((4, 64, 3), (8, 5, 50), (3, 1, 9), (16, 200, 2)):
        x, e = rng.integers(-top, top, (300, d)), rng.integers(-top, top, (k, d))
        dist = ((x[:, None] - e) ** 2).sum(axis=2)
        entry, error = V.nearest(x, e)
        assert (entry == dist.argmin(axis=1)).all() and (error == dist.min(axis=1)).all()


def test_codes_decode_to_entries(spark):
    rows = _rows(100, 32)
    books = V.learn_codebooks(_frame(spark, rows), parts=8, entries=16, rounds=1)
    assert books.shape == (8, 16, 4)
    for r in V.encode(_frame(spark, rows), books).collect():
        v = [math.floor(256 * x) for x in rows[r["vec_id"]][1]]
        assert sum((a - b) ** 2 for a, b in zip(v, V.decode(r["code"], books))) == r["error"]
    with pytest.raises(ValueError):
        V.learn_codebooks(_frame(spark, rows), entries=300)

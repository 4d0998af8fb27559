import math
import random

import pytest

from barlake.llm import topk as T


def _brute(rows, queries, k):
    def vector(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    known = [(i, vector(v)) for i, v in rows if i is not None]
    out = []
    for q, v in {(i, tuple(vector(v))) for i, v in rows if i in queries and vector(v) is not None}:
        best: dict = {}
        for i, w in known:
            if w is not None and i != q:
                best[i] = max(best.get(i, -1 << 62), sum(a * b for a, b in zip(v, w)))
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def _rows(spread, n=900):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = []
    for i in range(n):
        size = math.exp(rng.gauss(0, spread))
        rows.append((i, [size * (x + rng.gauss(0, 0.2)) for x in centres[i % 6]]))
    same = rows[0][1]
    rows += [(2000 + i, same) for i in range(50)]                                    # ties
    rows += [(3000, None), (3001, [1.0, None] * 6), (3002, [float("nan")] * 12), (3003, [float("inf")] * 12), (3004, [0.0] * 12), (3005, []), (3006, [1.0, -1.0]),
             (None, same), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_matches_brute_force(spark, monkeypatch, spread):
    for name, value in (("BLOCK", 64), ("QUERY_BLOCK", 16), ("SEED_ROWS", 64), ("COORDINATES", 3)):
        monkeypatch.setattr(T, name, value)
    rows = _rows(spread)
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = T.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == _brute(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 5)


def test_an_id_with_several_vectors_takes_one_place(spark, monkeypatch):
    monkeypatch.setattr(T, "RATIO", 1e9)                                             # one bucket, so one block
    rows = [(0, [1.0, 0.0]), *[(2, [float(x), 0.0]) for x in (10, 9, 8, 7, 6)], (3, [5.0, 0.0]), (4, [0.5, 0.0]), (4, [5.0, 1.0])]
    rng = random.Random(4)
    rows += [(10 + i % 7, [rng.gauss(0, 3), rng.gauss(0, 3)]) for i in range(80)]
    for part in (rows[:9], rows):
        vectors = spark.createDataFrame(part, "vec_id long, embedding array<double>")
        got = T.top_k(vectors, vectors.where("vec_id = 0"), 5)
        assert sorted(map(tuple, got.collect())) == _brute(part, {0}, 5)


def test_few_rows_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.25, 0.5])], schema)
    assert [tuple(r) for r in T.top_k(two, two.where("vec_id = 0"), 5).collect()] == [(0, 1, 1, 256 * 64 + 128 * 128)]
    none = spark.createDataFrame([], schema)
    assert T.top_k(none, none, 5).collect() == [] and T.top_k(two, none, 5).collect() == []


def test_large_components_are_exact(spark, monkeypatch):
    """No vector is left out for its size: products are exact up to a long and end there."""
    for name, value in (("BLOCK", 16), ("QUERY_BLOCK", 8), ("SEED_ROWS", 16), ("COORDINATES", 2)):
        monkeypatch.setattr(T, name, value)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) * 10.0 ** rng.uniform(-2, 7) for _ in range(6)]) for i in range(150)]
    rows += [(300, [60000.0, 1, 2, 3, 4, 5]), (301, [1.0e30, -1.0, 0, 0, 0, 0]), (302, [-1.0e30, 2.0 ** 40, 0, 0, 0, 0]), (303, [2.0 ** 50, 2.0 ** 50 + 1, -(2.0 ** 50), 3, 0, 0]), (350, [2.0 ** 54] * 6)]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    top = (1 << 63) - 1

    def vector(v):
        return [max(-top - 1, min(top, math.floor(x * 256))) for x in v]

    ints, want = {i: vector(v) for i, v in rows}, []
    for i in (i for i, _ in rows if i % 50 == 0 or i > 299):
        score = {j: max(-top - 1, min(top, sum(a * b for a, b in zip(ints[i], w)))) for j, w in ints.items() if j != i}
        want += [(i, r + 1, j, s) for r, (j, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5])]
    got = T.top_k(vectors, vectors.where("vec_id % 50 = 0 or vec_id > 299"), 5)
    assert sorted(map(tuple, got.collect())) == sorted(want)

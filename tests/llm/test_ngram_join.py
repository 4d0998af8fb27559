import random

import numpy as np
import pytest
from helpers import awkward_texts, documents, near_classes, shingles

from barlake.llm import ngram_join as J
from barlake.llm.components import components


def _copies(n, seed=3):
    """Near copies at all distances: texts of several lengths, each changed in more and more places."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for length in (12, 30, 80, 200):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for c in range(n):
            t = list(base)
            for _ in range(rng.randrange(1 + length // 12)):
                t[rng.randrange(length)] = rng.choice(vocabulary)
            if c % 5 == 0:
                t = t[:-1]
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_classes_match_brute_force(spark, monkeypatch, k, num, den):
    for name, value in (("BLOCK", 7), ("NAMED", 3 if k == 3 else 1 << 16)):          # meetings are cut into blocks, some are not named
        monkeypatch.setattr(J, name, value)
    rows = _copies(40)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(documents(spark, rows), k, num, den).collect()}
    want = near_classes(rows, k, num, den)
    assert got == {i: (len(shingles(t, k)), want[i]) for i, t in rows}
    assert len(set(want.values())) < 0.9 * len(rows)


def test_awkward_rows(spark):
    rows = awkward_texts()
    docs = documents(spark, [(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(docs).collect()]
    known = {i: t for i, t in rows if i is not None}
    want = near_classes(list(known.items()), 3, 90, 100)
    assert sorted(x for x in got if x[0] is not None) == sorted((i, len(shingles(t, 3)), want[i]) for i, t in rows if i is not None)
    assert [x for x in got if x[0] is None] == [(None, len(shingles(rows[0][1], 3)), 1)]      # the class of an equal set with an id
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i in known if want[i] == i}) and ids.count(None) == 1


def test_repeated_rows_are_one_row_in_every_task(spark, monkeypatch, tmp_path):
    """No group of sketches holds a repeated row twice, and no pair is verified twice."""
    folder = str(tmp_path)

    def noted(work, keys):
        def run(batches, **settings):
            from collections import Counter
            from uuid import uuid4
            batches = list(batches)
            for n in Counter(g for b in batches for g in zip(*(b.column(c).to_pylist() for c in keys), strict=True)).values():
                open(f"{folder}/{len(keys)}-{n}-{uuid4().hex}", "w").close()
            yield from work(iter(batches), **settings)
        return run

    for name, keys in (("_forests", ("group",)), ("_across", ("group",)), ("_verify", ("a", "b"))):
        monkeypatch.setattr(J, name, noted(getattr(J, name), keys))
    rows = _copies(6)
    many = rows + [rows[14]] * 300 + [(rows[14][0], rows[14][1].replace(" ", "  "))] * 300
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(documents(spark, many).repartition(5)).collect()}
    want = near_classes(rows, 3, 90, 100)
    assert got == {(i, len(shingles(t, 3)), want[i]) for i, t in rows}
    sizes = [tuple(map(int, f.name.split("-")[:2])) for f in tmp_path.iterdir()]
    assert max(n for keys, n in sizes if keys == 1) <= len(rows) and {n for keys, n in sizes if keys == 2} == {1}


def test_a_large_group_of_near_copies_gives_few_pairs(spark, monkeypatch, tmp_path):
    """All pairs of the group are linked, but only a forest of them is moved."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(400):
        t = list(base)
        t[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(t)))
    folder, verify = str(tmp_path), J._verify

    def counted(batches, **settings):
        from uuid import uuid4
        for b in batches:
            open(f"{folder}/{len(b)}-{uuid4().hex}", "w").close()
            yield from verify(iter([b]), **settings)

    monkeypatch.setattr(J, "_verify", counted)
    got = {r.doc_id: r.component_id for r in J.near_duplicates(documents(spark, rows), 5, 80, 100).collect()}
    assert set(got.values()) == {0}
    assert sum(int(f.name.split("-")[0]) for f in tmp_path.iterdir()) < 20 * len(rows)


def test_links_that_no_forest_pair_shows_are_found(spark):
    """A chain in which only neighbours are linked, next to sets that nearly are."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i:3 * i + 60])) for i in range(40)]
    rows += [(100 + i, " ".join(w if rng.random() > 0.02 else f"y{i}{w}" for w in words[30:90])) for i in range(60)]
    for k, num, den in ((3, 90, 100), (5, 80, 100), (2, 85, 100)):
        got = {r.doc_id: r.component_id for r in J.near_duplicates(documents(spark, rows), k, num, den).collect()}
        assert got == near_classes(rows, k, num, den)


def test_meetings_of_sorted_parts():
    import pyarrow as pa
    rows = [(1, 5), (2, 5), (2, 6), (3, 5), (3, 6), (4, 1), (4, 2), (4, 2), (4, 3), (9, 8)]
    batches = [pa.RecordBatch.from_pydict({"part": [r[0] for r in rows[i:i + 3]], "node": [r[1] for r in rows[i:i + 3]]}) for i in range(0, len(rows), 3)]
    got = {}
    for b in J._meet(iter(batches)):
        for m, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got.setdefault(m, []).append(n)
    assert sorted(map(sorted, got.values())) == [[1, 2, 3], [5, 6]]


def test_the_kept_rows_do_not_depend_on_the_order(spark):
    """Ids with several texts: each class of texts keeps one row, whatever the order."""
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(0, b, 1), (1, a, 2), (1, b, 3), (2, a, 4), (3, None, 5), (3, "", 6), (3, b, 7), (4, a, 8), (4, a, 9), (None, a, 10)]
    rng = random.Random(1)
    seen = set()
    for _ in range(4):
        rng.shuffle(rows)
        kept = J.keep_one(documents(spark, rows, "doc_id long, text string, n int").repartition(3))
        seen.add(tuple(sorted(map(tuple, kept.collect()), key=str)))
    assert len(seen) == 1
    kept = list(seen.pop())
    assert {r[:2] for r in kept} >= {(0, b), (1, a), (None, a)} and len(kept) == 4 and sum(r[0] == 3 and not r[1] for r in kept) == 1


def test_empty_table(spark):
    assert J.near_duplicates(documents(spark, [])).collect() == []


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(5)
    bands = J.Bands(90, 100)
    for n in (10, 11, 19, 20, 21, 57, 190, 1000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for _ in range(20):
            b = a[rng.random(len(a)) > 0.05]
            b = np.unique(np.concatenate((b, rng.integers(0, 1 << 63, int(0.04 * n), dtype=np.uint64))))
            if J.linked(a, b, 90, 100) and not np.array_equal(a, b):
                assert set(J.part_keys(a, bands).tolist()) & set(J.part_keys(b, bands).tolist())


@pytest.mark.parametrize("num,den", [(80, 100), (90, 100), (50, 100)])
def test_the_farthest_linked_sets_share_a_part(num, den):
    rng = np.random.default_rng(6)
    bands = J.Bands(num, den)
    for n in (*range(4, 60), 200, 999):
        for _ in range(4):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            extra = rng.integers(0, 1 << 63, n * (den - num) // num, dtype=np.uint64)
            cut = int(rng.integers(0, len(extra) + 1))
            a, b = np.unique(np.concatenate((both, extra[:cut]))), np.unique(np.concatenate((both, extra[cut:])))
            assert J.linked(a, b, num, den)
            if len(extra):
                assert set(J.part_keys(a, bands).tolist()) & set(J.part_keys(b, bands).tolist())


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(7, 7), (None, 3), (900, 901), (900, 901)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{200 + i: 200 for i in range(7)}, 900: 900, 901: 900}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []

import math

import pytest
from helpers import SPACED, awkward_texts, documents

from barlake.llm import mixing as M


def _targets(sizes: dict, cycle=(1, 2, 3), most=3):
    """Excess over the stops is reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        left, w = total - sum(stopped.values()), sum(weight[s] for s in rest)
        shares = {s: left * weight[s] / w for s in rest}
        over = [s for s in rest if shares[s] > most * sizes[s]]
        if not over:
            return {**stopped, **shares}
        stopped.update({s: most * sizes[s] for s in over})


def _docs(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 23)), ["b", "a", None, "big", "big", "big", "é"][i % 7], i) for i in range(300)]
    rows += [(1000 + i, t, "odd", i) for i, (_, t) in enumerate(awkward_texts())] + [(2000, None, "empty", 0), (None, "no id", "a", 0)]
    return documents(spark, rows, "doc_id long, text string, source string, taken int"), rows


@pytest.mark.parametrize("bins", [1, 7, 2048])
def test_targets_and_taken(spark, bins):
    docs, rows = _docs(spark)
    got = M.mix_plan(docs, bins=bins).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(SPACED.findall(t or ""))
    want = _targets(sizes)
    taken: dict = {}
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert 0 <= r.extra <= r.size and r.taken == r.epochs * r.size + r.extra <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
        parted = [r for r in got if r.source == s and 0 < r.extra < r.size]
        assert len(parted) <= 1                                             # whole documents but for the last one
    again = M.mix_plan(docs.repartition(5), bins=bins).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_better_documents_come_first_more_often(spark):
    rows = [(i, "w w w w", "rare" if i % 2 else "common") for i in range(4000)]
    docs = documents(spark, rows, "doc_id long, text string, source string")
    labels = documents(spark, [(i, 1 if i % 4 < 2 else 0) for i in range(4000)], "doc_id long, quality int")
    got = [r for r in M.mix_plan(docs, M.label_weights(labels)).collect() if r.source == "common"]
    share = [sum(r.extra > 0 for r in got if (r.doc_id % 4 < 2) == good) / (len(got) / 2) for good in (True, False)]
    assert share[0] > 1.5 * share[1]


def test_mix_repeats_rows(spark):
    docs, _ = _docs(spark)
    plan, mixed = M.mix_plan(docs), M.mix(docs)
    assert mixed.columns == docs.columns
    want: dict = {}
    for r in plan.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.epochs + (r.extra > 0 and 2 * r.extra >= r.size)
    got: dict = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert {i: n for i, n in want.items() if n} == got
    assert M.mix_plan(documents(spark, [], "doc_id long, text string, source string")).collect() == []


def test_repeated_rows_come_as_often_as_all_of_them(spark):
    """Equal rows, two texts of an id, rows without ids: no copy is lost, the words come near the target."""
    rows = [(1, "w w w", "a", 0)] * 500 + [(2, "x y", "a", 0), (2, "y x", "a", 0)] + [(None, f"t{i} u", "b", i) for i in range(300)] + [(i, "v v v v", "c", 0) for i in range(10, 160)]
    docs = documents(spark, rows, "doc_id long, text string, source string, _n int").repartition(4)
    plan, mixed = M.mix_plan(docs).collect(), M.mix(docs)
    assert len(plan) == len(rows) and mixed.columns == docs.columns
    target = {r.source: r.target for r in plan}
    words: dict = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    for s, t in target.items():
        assert abs(words.get(s, 0) - t) <= 4
        assert abs(sum(r.taken for r in plan if r.source == s) - t) <= 1
    assert len({r.text for r in mixed.collect() if r.source == "b"}) > 100
    assert [r for r in M.mix_plan(docs).collect() if r.doc_id == 1 and 0 < r.extra < r.size] == [] or sum(0 < r.extra < r.size for r in plan if r.source == "a") <= 1


def test_only_dataframe_operations(spark):
    docs, _ = _docs(spark)
    plan = M.mix_plan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

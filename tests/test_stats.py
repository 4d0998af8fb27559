"""Exact quantiles by range partitioning vs brute force (numpy), incl. skew, ties and few partitions."""
import numpy as np
import pytest

from barlake.operators import stats


def _np_quantile(v, p):
    return float(np.quantile(np.asarray(v, dtype=float), p, method="linear"))


@pytest.mark.parametrize("partitions", ["1", "3", "8"])
def test_grouped_quantiles_match_numpy(spark, partitions):
    rng = np.random.default_rng(7)
    rows = []
    # one hot group with a third of the rows, heavy ties, a single-row and a constant group
    rows += [("hot", float(x)) for x in rng.integers(0, 40, 3000)]
    rows += [("wide", float(x)) for x in rng.normal(0, 1e6, 2500)]
    rows += [("one", 3.5)]
    rows += [("const", 2.0)] * 300
    rows += [("nulls", None)] * 5
    rows += [("mixed", float(x)) for x in rng.exponential(3, 1200)] + [("mixed", None)] * 10
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.01, 0.05, 0.5, 0.95, 0.99, 1.0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = stats.exact_quantiles(df, "v", probs, ["g"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    for r in got:
        vals = [v for v in by[r["g"]] if v is not None]
        if not vals:
            assert r["quantile"] is None
        else:
            assert r["quantile"] == pytest.approx(_np_quantile(vals, r["prob"]), rel=1e-12, abs=1e-12)
    assert len(got) == len(by) * len(probs)


def test_global_describe_matches_pandas(spark):
    import pandas as pd
    rng = np.random.default_rng(3)
    vals = list(rng.standard_t(3, 5000)) + [None] * 20
    df = spark.createDataFrame([(None if v is None else float(v),) for v in vals], "x double")
    row = stats.describe(df, "x").collect()[0]
    pdesc = pd.Series([v for v in vals if v is not None]).describe(percentiles=[0.01, 0.05, 0.5, 0.95, 0.99])
    assert row["count"] == pdesc["count"]
    for ours, theirs in [("mean", "mean"), ("std", "std"), ("min", "min"), ("p01", "1%"), ("p05", "5%"),
                         ("p50", "50%"), ("p95", "95%"), ("p99", "99%"), ("max", "max")]:
        assert row[ours] == pytest.approx(pdesc[theirs], rel=1e-9, abs=1e-12)


def test_histogram_last_bin_closed_and_constant(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 10]], "x double")
    h = {r["bin"]: r["count"] for r in stats.histogram(df, "x", bins=5).collect()}
    assert h == {0: 2, 1: 2, 2: 1, 3: 0, 4: 1}
    const = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert sorted((r["bin"], r["count"]) for r in stats.histogram(const, "x").collect()) == [(0, 2)] + [(i, 0) for i in range(1, 80)]
    assert stats.histogram(const.where("x > 5"), "x").count() == 0


def test_quantiles_empty_input(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert stats.exact_quantiles(df, "v", [0.5], ["g"]).count() == 0


def test_describe_approx_close_to_exact(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(0, 1, 20000)], "x double")
    exact = stats.describe(df, "x").collect()[0]
    approx = stats.describe(df, "x", approx=True).collect()[0]
    assert approx["count"] == exact["count"] and approx["mean"] == pytest.approx(exact["mean"])
    for c in ("p01", "p05", "p50", "p95", "p99"):
        assert abs(approx[c] - exact[c]) < 0.05


def test_a_null_group_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 4.0)], "g string, v double")
    got = {r["g"]: r["quantile"] for r in stats.exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert got == {None: 2.0, "a": None, "b": 4.0}
    d = {r["g"]: (r["count"], r["mean"], r["std"]) for r in stats.describe(df, "v", keys=["g"]).collect()}
    assert d == {None: (2, 2.0, pytest.approx(2 ** 0.5)), "a": (0, None, None), "b": (1, 4.0, None)}


def test_neither_loops_nor_collects(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, v double")
    plan = stats.exact_quantiles(df, "v", [0.5], ["g"])._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "InMemoryRelation" not in plan

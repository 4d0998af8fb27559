"""Metamorphic properties: input order/partitioning never changes a result; replays are idempotent."""
from pyspark.sql import functions as F

from barlake.operators import correlation, curate, quality, returns, stats
from barlake.plans import frames
from harness import rows_digest


def _digest(df):
    return rows_digest(df.columns, [tuple(r) for r in df.collect()])[1]


def test_repartition_and_shuffle_invariance(spark, sf_dir):
    bars = frames.faulted(spark, sf_dir).cache()
    shuffled = bars.repartition(7, F.rand(11)).cache()
    for op in (quality.ticker_coverage, quality.null_rates, quality.ohlc_violations,
               lambda d: returns.return_zscores(returns.daily_returns(d)),
               lambda d: stats.describe(returns.daily_returns(d), "ret_1d"),
               lambda d: stats.exact_quantiles(d, "volume", [0.5], ["ticker"])):
        assert _digest(op(bars)) == _digest(op(shuffled))


def test_latest_wins_replay_idempotent(spark, sf_dir):
    ing = frames.hashed_ingests(spark, sf_dir)
    once = curate.latest_wins(ing)
    twice = curate.latest_wins(ing.unionByName(ing).repartition(5))
    assert _digest(once) == _digest(twice)
    assert _digest(curate.exact_dedupe(ing.unionByName(ing))) == _digest(curate.exact_dedupe(ing))


def test_correlation_symmetric_block_invariance(spark, sf_dir):
    m = frames.user_matrix(spark, sf_dir)
    a = correlation.return_correlation(m, block_size=3)
    b = correlation.return_correlation(m.repartition(3), block_size=1000)
    assert _digest(a) == _digest(b)

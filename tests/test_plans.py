"""Plan shape: no Python row UDFs, no cartesian products, pushed filters and pruned columns."""
import pytest

import __spark_entry__ as entry
from barlake.plans import catalog

SKIP = {"stream_copy_promote", "stream_raw_to_conformed", "stream_snapshot_refresh", "promote_incremental", "curated_scan"}
NAMES = sorted(set(catalog.all_queries()) - SKIP)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian_or_row_udf(spark, sf_dir, name):
    plan = _plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_window_filter_prunes_scan(spark, sf_dir):
    df = entry.queries()["series_for_ticker"](spark, sf_dir)
    plan = _plan(df)
    assert "ReadSchema: struct<l_orderkey" in plan
    assert "l_tax" not in plan  # unused lineitem columns are not read


def test_event_filter_pushed_down(spark, sf_dir):
    plan = _plan(entry.queries()["stale_partitions"](spark, sf_dir))
    assert "PushedFilters: [In(event_type" in plan or "PushedFilters: [IsNotNull(event_type), In(event_type" in plan

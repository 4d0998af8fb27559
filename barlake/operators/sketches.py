"""Mergeable profiles: daily sketches stored as binary state, merged for any range of days.

A day's rows are read once; a profile of any range then costs a read of one
short row per day.  Distinct counts come from HyperLogLog sketches, quantiles
from KLL sketches.  Errors (see ``DISTINCT_ERROR``, ``RANK_ERROR``) hold for
merged sketches as for those of the whole range.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: HyperLogLog registers as a power of two; relative standard error 1.04 / sqrt(2^14) = 0.8 %.
HLL_REGISTERS = 14
#: KLL size parameter; normalised rank error of one quantile about 0.4 % at 99 % confidence.
KLL_SIZE = 800
#: Bounds that the estimates keep with a margin of several standard errors.
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.02


def daily_sketches(df: DataFrame, day: str, distinct: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per day: rows, a distinct sketch of each column of ``distinct`` and, of each measure, count, least, greatest and a quantile sketch.

    Sketches are combined on the map side, so a day with a third of all rows
    costs one merge of partial sketches a task.  Null values are not sketched.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.hll_sketch_agg(c, HLL_REGISTERS).alias(f"{c}_distinct") for c in distinct]
    for c in measures:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}_count"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), F.kll_sketch_agg_double(x, KLL_SIZE).alias(f"{c}_quantiles")]
    return df.groupBy(day).agg(*aggs)


def merged_profile(sketches: DataFrame, by: Sequence[Column], distinct: Sequence[str], measures: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """Profiles of groups of days: rows, ``<column>_estimate``, and of each measure count, min, max and ``<measure>_p<percent>``.

    A group in which a measure has no values has null quantiles.
    """
    aggs = [F.sum("rows").alias("rows")]
    aggs += [F.hll_sketch_estimate(F.hll_union_agg(f"{c}_distinct", False)).alias(f"{c}_estimate") for c in distinct]
    for c in measures:
        aggs += [F.sum(f"{c}_count").alias(f"{c}_count"), F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max"),
                 F.kll_merge_agg_double(f"{c}_quantiles", KLL_SIZE).alias(f"_{c}")]
    merged = sketches.groupBy(*by).agg(*aggs)
    for c in measures:
        for q in quantiles:
            value = F.kll_sketch_get_quantile_double(F.col(f"_{c}"), F.lit(float(q)))
            merged = merged.withColumn(f"{c}_p{round(100 * q):02d}", F.when(F.col(f"{c}_count") > 0, value))
    return merged.drop(*[f"_{c}" for c in measures])

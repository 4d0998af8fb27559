"""Distribution statistics: exact quantiles by range partitioning, describe, histogram.

``exact_quantiles`` returns the same values as ``quantile_cont`` / pandas'
linear interpolation.  Equal values of a group are counted first (combined
before the shuffle, so heavy ties cost one row), the counted values are range
partitioned by (group, value) and stored sorted; a group of any size is spread
over as many partitions as it needs.  A small table of counts per partition and
group then tells which partition holds each wanted rank, and only rows of
those partitions are looked at again.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from ..spec import DESCRIBE_PERCENTILES, HIST_BINS

ACCURACY = 10000


def _counted(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """(keys, x, n, _part): distinct values with their counts, range partitioned and stored; nulls are kept with n."""
    counted = df.select(*keys, F.col(value).cast("double").alias("x")).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n"))
    ranged = counted.repartitionByRange(*keys, "x").sortWithinPartitions(*keys, "x")
    return stored(ranged.withColumn("_part", F.spark_partition_id()), "quantiles")


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str], prefix: str) -> tuple:
    """(join condition, renamed b) for a null-safe join on ``keys``."""
    renamed = b.select(*[F.col(c).alias(prefix + c if c in keys else c) for c in b.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(prefix + k))
    return cond, renamed


def _pick(values: DataFrame, probs: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """(keys, prob, quantile) from counted values; an all-null group gives null quantiles."""
    keys = list(keys)
    real = F.when(F.col("x").isNotNull(), F.col("n")).otherwise(F.lit(0))
    parts = values.groupBy(*keys, "_part").agg(F.sum(real).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    at = F.col("prob") * (F.col("_total") - 1)
    ranks = (parts.groupBy(*keys).agg(F.sum("_rows").alias("_total")).withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
             .select(*keys, "prob", F.when(F.col("_total") > 0, F.floor(at)).alias("r_lo"),
                     F.when(F.col("_total") > 0, F.least(F.floor(at) + 1, F.col("_total") - 1)).alias("r_hi"), (at - F.floor(at)).alias("frac")))
    wanted = ranks.select(*keys, F.explode(F.array("r_lo", "r_hi")).alias("r")).where("r is not null").distinct()
    cond, there = _same(wanted, parts, keys, "_p_")
    wanted = wanted.join(there, cond & (F.col("r") >= F.col("_offset")) & (F.col("r") < F.col("_offset") + F.col("_rows"))).select(*keys, "_part", "r", (F.col("r") - F.col("_offset")).alias("k"))
    cond, asked = _same(values, wanted, [*keys, "_part"], "_w_")
    cond = cond & F.col("_part").eqNullSafe(F.col("_w__part"))
    touched = values.where("x is not null").join(asked.select(*["_w_" + k for k in keys], "_w__part").distinct(), cond, "left_semi")
    inside = Window.partitionBy(*keys, "_part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    placed = touched.withColumn("_before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    found = (placed.join(asked, cond & (F.col("k") >= F.col("_before")) & (F.col("k") < F.col("_before") + F.col("n"))).select(*keys, "r", "x"))
    out = ranks
    for side in ("lo", "hi"):
        cond, v = _same(out, found.withColumnRenamed("x", f"v_{side}").withColumnRenamed("r", f"_r_{side}"), keys, f"_{side}_")
        out = out.join(v, cond & (F.col(f"r_{side}") == F.col(f"_r_{side}")), "left")
    return out.select(*keys, "prob", (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac")).alias("quantile"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` per group ``keys``.

    Returns ``keys..., prob, quantile`` (one row per group and probability);
    nulls are ignored, an all-null group gives a null quantile.
    """
    if not keys:
        return exact_quantiles(df.withColumn("_g", F.lit(0)), value, probs, ["_g"]).drop("_g")
    return _pick(_counted(df, value, keys), probs, keys)


def describe(df: DataFrame, value: str, percentiles: Sequence[float] = DESCRIBE_PERCENTILES,
             keys: Sequence[str] = (), approx: bool = False, accuracy: int = ACCURACY) -> DataFrame:
    """pandas ``describe``: count, mean, std (sample), min, percentiles, max — one row per group.

    Percentile columns are named ``p01``, ``p05``, ``p50`` ... (hundredths).
    The moments come from the same stored counts as the percentiles (the
    deviation in a second pass around the mean).  ``approx=True`` takes the
    percentiles from one ``percentile_approx`` sketch per group instead (a
    single pass, rank error about 1/accuracy).
    """
    keys = list(keys)
    names = {float(p): f"p{round(p * 100):02d}" for p in percentiles}
    x = F.col(value)
    if approx:
        q = F.percentile_approx(x, list(names), accuracy)
        out = df.groupBy(*keys).agg(F.count(x).alias("count"), F.avg(x).alias("mean"),
                                    F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                                    q.alias("_q"), F.max(x).alias("max"))
        return out.select(*keys, "count", "mean", "std", "min",
                          *[F.col("_q")[i].alias(n) for i, n in enumerate(names.values())], "max")
    if not keys:
        return describe(df.withColumn("_g", F.lit(0)), value, percentiles, ["_g"]).drop("_g")
    values = _counted(df, value, keys)
    real = F.when(F.col("x").isNotNull(), F.col("n"))
    moments = values.groupBy(*keys).agg(F.coalesce(F.sum(real), F.lit(0)).alias("count"), F.try_divide(F.sum(F.col("x") * F.col("n")), F.sum(real)).alias("mean"),
                                        F.min("x").alias("min"), F.max("x").alias("max"))
    cond, m = _same(values, moments, keys, "_m_")
    spread = (values.join(m, cond).groupBy(*keys).agg(F.sum(F.col("n") * F.pow(F.col("x") - F.col("mean"), 2)).alias("_ss")))
    wide = _pick(values, percentiles, keys).groupBy(*keys).agg(*[F.max(F.when(F.col("prob") == F.lit(p), F.col("quantile"))).alias(n) for p, n in names.items()])
    out = moments
    for part, prefix in ((spread, "_s_"), (wide, "_q_")):
        cond, p = _same(out, part, keys, prefix)
        out = out.join(p, cond)
    std = F.when(F.col("count") > 1, F.sqrt(F.col("_ss") / (F.col("count") - 1)))
    return out.select(*keys, "count", "mean", std.alias("std"), "min", *names.values(), "max")


def histogram(df: DataFrame, value: str, bins: int = HIST_BINS, weight: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed; every bin, empty ones with count 0.

    Returns ``bin, bin_lo, bin_hi, count``; no rows without values.  The range
    is a scalar subquery (one partial aggregation), then a grouped count per bin.
    """
    x = F.col(value)
    clean = df.where(x.isNotNull())
    rng = clean.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo_hi = clean.select(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    w = F.col(weight) if weight else F.lit(1)
    counted = clean.groupBy(bin_of(x, lo_hi.getField("lo"), lo_hi.getField("hi"), bins).alias("bin")).agg(F.sum(w).cast("bigint").alias("count"))
    return all_bins(rng, counted, bins)


def bin_of(x, lo, hi, bins: int):
    """The bin of a value between ``lo`` and ``hi`` (0 if they are equal)."""
    return F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((x - lo) * bins / (hi - lo)), F.lit(bins - 1))).cast("int")


def all_bins(rng: DataFrame, counted: DataFrame, bins: int) -> DataFrame:
    """``bin, bin_lo, bin_hi, count`` of every bin; ``rng`` is one row (lo, hi), ``counted`` has (bin, count)."""
    every = rng.where("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = every.join(counted.withColumnRenamed("bin", "_b"), F.col("bin") == F.col("_b"), "left")
    lo, hi = F.col("lo"), F.col("hi")
    return out.select("bin", (lo + F.col("bin") * (hi - lo) / bins).alias("bin_lo"), (lo + (F.col("bin") + 1) * (hi - lo) / bins).alias("bin_hi"),
                      F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))

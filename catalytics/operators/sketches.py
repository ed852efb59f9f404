"""Mergeable price summaries (A7, A14 for any period): one KLL sketch per category and period, merged on demand.

The exact jobs (``aggregates.price_distribution``) read every row again for every period.  Here each
(category, period) leaves one sketch of a few kilobytes; quantiles of any run of periods come from
the merged sketches alone.  A quantile's rank is off by at most ``RANK_ERROR`` of the rows (the
sketch's own bound for ``K`` items at 99 % confidence); up to ``K`` values a sketch is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 800
RANK_ERROR = 0.005


def period_sketches(rows: DataFrame, key: str, period: Column, value: str, k: int = K) -> DataFrame:
    """key, period, n, sketch: the summary table that is stored; sketches are built before the shuffle and merged after it."""
    v = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, period.alias("period"), F.col(value).cast("double").alias("v"))
    return v.groupBy(key, "period").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("v", k).alias("sketch"))


def merged_quantiles(sketches: DataFrame, key: str, first, last, probabilities: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """key, n, q (array): quantiles over the periods from ``first`` to ``last``, both included."""
    merged = sketches.where(F.col("period").between(first, last)).groupBy(key).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(key, "n", F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for p in probabilities]).alias("q"))


def rank_errors(rows: DataFrame, quantiles: DataFrame, key: str, value: str, probabilities: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """key, n, worst: the largest distance between a probability and the share of rows at or below (or below) its quantile."""
    met = rows.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("v")).join(quantiles, F.col("_k") == F.col(key))
    parts = []
    for i, p in enumerate(probabilities):
        at = F.col("q")[i]
        upto, below = F.avg((F.col("v") <= at).cast("double")), F.avg((F.col("v") < at).cast("double"))
        parts.append(F.greatest(F.lit(p) - upto, below - F.lit(p), F.lit(0.0)))
    return met.groupBy(key, "n").agg(F.greatest(*parts, F.lit(0.0)).alias("worst"))

"""Exact quantiles of large groups, without a buffer of all values and without ordering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalytics.session import scratch_path

RANGES = 1000                  # equal-width value ranges in which the wanted ranks are located


def counted_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, v (double), m: how often each value occurs in each group, written in the shared folder.

    The one shuffle of the rows; it combines before the shuffle, so a hot group is no hot task.
    """
    v = rows.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(key, F.col(value).cast("double").alias("v"))
    counts = v.groupBy(key, "v").agg(F.count("*").alias("m"))
    path, schema = scratch_path(rows.sparkSession, "values"), counts.schema
    counts.write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def value_quantiles(values: DataFrame, key: str, probabilities: tuple[float, ...], ranges: int = RANGES, few_keys: bool = False) -> DataFrame:
    """key, q (array of doubles) of counted values: linear interpolation between the two nearest ranks, as pandas does.

    Counts per value range locate the wanted ranks; only the ranges that hold one are ordered.
    ``few_keys`` promises a small fixed number of groups, whose spans and ranks are then broadcast.
    """
    small = F.broadcast if few_keys else (lambda d: d)
    span = values.groupBy(key).agg(F.sum("m").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * ranges),
                                                      F.lit(ranges - 1).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    placed = values.join(small(span), key).select(key, "v", "m", "n", place.alias("place"))
    upto = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    counts = placed.groupBy(key, "n", "place").agg(F.sum("m").alias("m")).withColumn("upto", F.sum("m").over(upto))
    # both neighbours of every wanted position, as ranks from 1
    at = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(p))).alias("at")) for i, p in enumerate(probabilities)])
    held = counts.select(F.col(key).alias("_key"), F.col("place").alias("_place"), (F.col("upto") - F.col("m")).alias("before"), F.filter(
        F.flatten(F.transform(at, lambda a: F.array(
            F.struct(a["i"].alias("i"), a["at"].alias("at"), (F.floor(a["at"]) + 1).alias("rank")),
            F.struct(a["i"].alias("i"), a["at"].alias("at"), (F.ceil(a["at"]) + 1).alias("rank"))))),
        lambda w: (w["rank"] > F.col("upto") - F.col("m")) & (w["rank"] <= F.col("upto"))).alias("wanted")).where(F.size("wanted") > 0)
    inner = placed.join(small(held), (F.col(key) == F.col("_key")) & (F.col("place") == F.col("_place")))
    upto = Window.partitionBy(key, "place").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inner = inner.withColumn("top", F.col("before") + F.sum("m").over(upto))
    hit = inner.select(key, "v", F.inline(F.array_distinct(F.filter(
        "wanted", lambda w: (w["rank"] > F.col("top") - F.col("m")) & (w["rank"] <= F.col("top"))))))
    share = F.when(F.col("rank") == F.floor("at") + 1, 1 - (F.col("at") - F.floor("at"))).otherwise(F.col("at") - F.floor("at"))
    each = hit.groupBy(key, "i").agg(F.sum(F.col("v") * share).alias("q"))
    return each.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))


def exact_quantiles(rows: DataFrame, key: str, value: str, probabilities: tuple[float, ...], ranges: int = RANGES) -> DataFrame:
    """key, q of rows: ``value_quantiles`` of their counted values."""
    return value_quantiles(counted_values(rows, key, value), key, probabilities, ranges)

"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Targets.  The mix takes ``share`` of all words.  Sources share it by weight; a source whose part
would exceed ``epochs`` times its own words is clamped there, and the excess goes to the others by
weight until none is above its cap.  In order of cap to weight the clamped sources come first, so
the water level follows from prefix sums over one row per source, in whole numbers.

Repetitions.  A source with target t and s words repeats every document floor(t / s) times; the
remaining words come from documents in a seeded order (md5 of seed and id): all that fit whole,
and the one at the edge in part.  The edge is found in two steps, first among 65,536 ranges of the
hash, then inside the one range that holds it, so no source is ordered in one task.

Special cases: a null text has size 0; a null source is a source of its own, last in order; rows
without words take none; repeated rows that tie at the edge share its words evenly (rounded down);
null ids hash as empty text; an empty table gives an empty result; other columns are ignored (the
pipeline stage keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalytics.llm import frames
from catalytics.llm.text import WORD


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)       # by the source's place in order, repeating
    share: tuple[int, int] = (3, 2)            # words of the mix over words of the corpus, as a fraction
    epochs: int = 2
    seed: str = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def order_hash(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_targets(totals: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, source_size, target, whole, rest from one row per source (source, source_size)."""
    (p, q), everyone = mix.share, Window.partitionBy(F.lit(0))
    place = F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in mix.weights)), ((F.col("place") - 1) % len(mix.weights) + 1).cast("int"))
    ahead = everyone.orderBy((F.col("source_size") / F.col("weight")), "place")
    s = totals.withColumn("place", place).withColumn("weight", weight)
    s = s.withColumn("before", F.coalesce(F.sum("source_size").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    s = s.withColumn("level_n", p * F.sum("source_size").over(everyone) - q * mix.epochs * F.col("before"))
    s = s.withColumn("level_d", q * F.sum("weight").over(ahead.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("clamped", F.col("level_n") * F.col("weight") >= mix.epochs * F.col("source_size") * F.col("level_d"))
    level = F.min(F.when(~F.col("clamped"), F.struct(F.col("source_size") / F.col("weight"), "place", "level_n", "level_d"))).over(everyone)
    s = s.withColumn("level", level)
    part_n, part_d, size = F.col("weight") * F.col("level.level_n"), F.col("level.level_d"), F.col("source_size")
    whole = F.when(F.col("clamped"), F.lit(mix.epochs).cast("long")).otherwise(F.expr("(weight * level.level_n) div (level.level_d * source_size)"))
    words_of = F.when(F.col("clamped"), mix.epochs * size).otherwise(F.expr("(weight * level.level_n) div level.level_d"))
    target = F.when(F.col("clamped"), (mix.epochs * size).cast("double")).otherwise(part_n.cast("double") / part_d.cast("double"))
    return s.select("source", "source_size", target.alias("target"), whole.alias("whole"), (words_of - whole * size).alias("rest"))


def plan(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per source: its targets, and the edge (hash, size, words) of its partial repetition.  ``sizes`` has source, size, h."""
    ranged = sizes.withColumn("range", F.substring("h", 1, 4))
    ranges = frames.cut(ranged.groupBy("source", "range").agg(F.sum("size").alias("words")), "ranges")
    targets = frames.cut(source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), mix), "targets")
    t = targets.select(F.col("source").alias("t_source"), "rest")
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    edge = ranges.withColumn("upto", F.sum("words").over(upto)).join(t, F.col("source").eqNullSafe(F.col("t_source"))).where(
        (F.col("upto") - F.col("words") <= F.col("rest")) & (F.col("rest") < F.col("upto"))).select(
        F.col("source").alias("e_source"), F.col("range").alias("e_range"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))
    near = ranged.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("range") == F.col("e_range")))
    keys = near.groupBy("e_source", "h", "size", "left").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("e_source").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    keys = keys.withColumn("upto", F.sum(F.col("size") * F.col("n")).over(upto)).withColumn("words", F.col("size") * F.col("n"))
    keys = keys.where((F.col("upto") - F.col("words") <= F.col("left")) & (F.col("left") < F.col("upto"))).select(
        "e_source", F.col("h").alias("edge_h"), F.col("size").alias("edge_size"), F.expr("(left - upto + words) div n").alias("edge_words"))
    return frames.cut(targets.join(keys, F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_source").withColumnRenamed("source", "p_source"), "plan")


def partial_words(h: Column, size: Column) -> Column:
    """Words a document adds beyond its whole repetitions, given its source's row of the plan."""
    before = (h < F.col("edge_h")) | ((h == F.col("edge_h")) & (size < F.col("edge_size")))
    at = (h == F.col("edge_h")) & (size == F.col("edge_size"))
    return F.when(before, size).when(at, F.col("edge_words")).otherwise(F.lit(0).cast("long"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mix = frames.table(spark, sf_dir, "documents"), Mix()
    sizes = frames.cut(docs.select("doc_id", "source", words(docs["text"]).alias("size"), order_hash(docs["doc_id"], mix.seed).alias("h")), "sizes")
    sources = plan(sizes.select("source", "size", "h"), mix)
    mixed = sizes.join(sources, sizes["source"].eqNullSafe(sources["p_source"]))
    taken = F.col("whole") * F.col("size") + partial_words(F.col("h"), F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS weight FROM s),
l AS (
  SELECT *, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, place
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level_n,
         2 * sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_d FROM w),
c AS (SELECT *, level_n * weight >= 2 * source_size * level_d AS clamped FROM l),
f AS (SELECT level_n AS n, level_d AS d FROM c WHERE NOT clamped ORDER BY source_size / weight, place LIMIT 1),
t AS (
  SELECT c.source, source_size,
         CASE WHEN clamped THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(weight * f.n AS DOUBLE) / CAST(f.d AS DOUBLE) END AS target,
         CASE WHEN clamped THEN 2 ELSE (weight * f.n) // (f.d * source_size) END AS whole,
         CASE WHEN clamped THEN 2 * source_size ELSE (weight * f.n) // f.d END AS words FROM c LEFT JOIN f ON true),
k AS (
  SELECT source, h, size, count(*) AS n, sum(size * count(*)) OVER (PARTITION BY source ORDER BY h, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d GROUP BY source, h, size)
SELECT d.doc_id, d.size, t.source_size, t.target,
       CAST(t.whole * d.size + CASE WHEN k.upto <= t.words - t.whole * t.source_size THEN d.size
         WHEN k.upto - d.size * k.n <= t.words - t.whole * t.source_size
         THEN (t.words - t.whole * t.source_size - k.upto + d.size * k.n) // k.n ELSE 0 END AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.h = d.h AND k.size = d.size
"""

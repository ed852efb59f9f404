"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is one Spark job over the links; labels stay in tables, nothing is collected but one
row of totals that tells whether the round changed anything.  The number of rounds grows with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalytics.llm import frames


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Link nodes to the least node among them and their neighbours: the larger ones (large), else the smaller and itself."""
    if large:
        sides = links.union(links.select("v", "u")).toDF("u", "v")
    else:
        sides = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    met = sides.join(least, sides["u"] == least["w"])
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node in ``links`` (columns u, v: long)."""
    links = frames.cut(links.where("u != v").distinct(), "links")
    before = None
    while True:
        links = frames.cut(_stars(_stars(links, True), False), "links")
        totals = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if totals == before:
            break
        before = totals
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""KMeans on (price, demand score) for every category at once (M12), with several starts.

Equal (category, price, score) points are one point with a weight.  Every category is clustered
from ``STARTS`` seedings and keeps the one of least inertia: start 0 takes the points at the ranks
(2i+1)/2k by (score, price), the others draw centers with a chance in proportion to the squared
distance to the nearest center so far.  A draw is a race: each point's ``-ln(u) / (weight *
distance)`` with u from a hash of the point, the start and the turn; the smallest wins.  So a draw
is one minimum per (category, start), and gives the same centers on every run.

Categories of at most ``IN_TASK`` distinct points are clustered whole, each inside one task.  Larger
ones go through the same steps over all tasks: points are dealt once by (category, share) and stay
so, a step ships only centers and sums, and a (category, start) whose centers stand still leaves
the loop.  Neither way bounds the number of steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalytics.functions.scalars import JOIN_SHARES, join_by_share
from catalytics.session import scratch_path

CAT = "categoryName"
STARTS = 10                    # fixed value: the reference's number of starts
IN_TASK = 100_000              # distinct points of a category that one task clusters (a few MB)
SCORE_RANGES = 1000            # ranges of the demand score in which the seed ranks are located
_KEY = ["c", "start"]


def _written(df: DataFrame, name: str) -> DataFrame:
    """Write a step's table to the shared folder and read it back (cuts the lineage)."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _uniform(start: Column | int, turn: int) -> Column:
    """A number in (0, 1] from the point, the start and the turn."""
    h = F.xxhash64("x", "y", F.lit(start) if isinstance(start, int) else start.cast("int"), F.lit(turn))
    return (h.cast("double") / 2.0 ** 64 + 0.5) * (1 - 2.0 ** -52) + 2.0 ** -53


# ---- one category inside a task ----

def _distances(x, y, centers: np.ndarray, sx: float, sy: float) -> np.ndarray:
    """Squared distance of every point to every center, in standard deviations."""
    dx = (x[:, None] - centers[:, 0]) / sx if sx > 0 else np.zeros((len(x), len(centers)))
    dy = (y[:, None] - centers[:, 1]) / sy if sy > 0 else np.zeros((len(x), len(centers)))
    return dx * dx + dy * dy


def rank_seeds(x, y, m, k: int) -> np.ndarray:
    order = np.lexsort((x, y))
    upto, n = np.cumsum(m[order]), int(m.sum())
    kk = min(k, n)
    ranks = [(2 * i + 1) * n // (2 * kk) + 1 for i in range(kk)]
    at = order[np.searchsorted(upto, ranks)]
    return np.stack([x[at], y[at]], 1)


def drawn_seeds(x, y, m, u: np.ndarray, k: int, sx: float, sy: float) -> np.ndarray:
    """u: turns x points.  Ties of the race go to the smaller (x, y)."""
    centers = np.zeros((0, 2))
    for turn in range(min(k, int(m.sum()))):
        near = _distances(x, y, centers, sx, sy).min(axis=1) if turn else np.ones(len(x))
        with np.errstate(divide="ignore"):
            race = np.where(near > 0, -np.log(u[turn]) / (m * near), np.inf)
        won = np.lexsort((y, x, race))[0]
        centers = np.concatenate([centers, [[x[won], y[won]]]])
    return centers


def lloyd(x, y, m, centers: np.ndarray, sx: float, sy: float) -> tuple[np.ndarray, float]:
    """Steps until the centers stand still or the inertia falls no more; an empty cluster keeps its center."""
    best = np.inf
    while True:
        d = _distances(x, y, centers, sx, sy)
        own = d.argmin(axis=1)
        inertia = float((d[np.arange(len(x)), own] * m).sum())
        if not inertia < best:
            return centers, best
        best = inertia
        n, sums = np.bincount(own, m, len(centers)), [np.bincount(own, m * v, len(centers)) for v in (x, y)]
        held = n > 0
        moved = centers.copy()
        moved[held] = np.stack([s[held] / n[held] for s in sums], 1)
        if (moved == centers).all():
            return centers, best
        centers = moved


def _clusters_in_task(k: int, starts: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        x, y, m = (group[c].to_numpy(float) for c in ("x", "y", "m"))
        sx, sy = float(group["sp"].iloc[0]), float(group["ss"].iloc[0])
        u = np.array(group["u"].tolist(), float).T            # (start, turn) x points
        found = []
        for start in range(starts):
            seeds = drawn_seeds(x, y, m, u[(start - 1) * k:start * k], k, sx, sy) if start else rank_seeds(x, y, m, k)
            found.append(lloyd(x, y, m, seeds, sx, sy))
        centers, inertia = min(found, key=lambda f: round(f[1], 6))
        return pd.DataFrame({CAT: group[CAT].iloc[0], "cx": centers[:, 0], "cy": centers[:, 1], "inertia": inertia, "first": found[0][1]})
    return run


# ---- one category over all tasks ----

def _rank_seeds(points: DataFrame, k: int) -> DataFrame:
    """c, cid, cx, cy: the points at the ranks (2i+1)/2k of each category by (score, price).

    Ranks are located in two steps, counts per score range first and then the points of
    the at most k ranges that hold a rank, so no task orders a category.
    """
    ranged = points.withColumn("_range", F.floor(F.col("y") / 100.0 * SCORE_RANGES))
    counts = ranged.groupBy("c", "_range").agg(F.sum("m").alias("n"))
    upto = Window.partitionBy("c").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("rows", F.sum("n").over(Window.partitionBy("c")))
    kk = F.least(F.col("rows"), F.lit(k))
    ranks = counts.select("c", "_range", (F.col("upto") - F.col("n")).alias("before"), "upto", F.explode(F.transform(
        F.sequence(F.lit(0).cast("bigint"), kk - 1),
        lambda i: F.struct(i.cast("int").alias("cid"), (F.floor((2 * i + 1) * F.col("rows") / (2 * kk)) + 1).alias("rank")))).alias("r"))
    ranks = ranks.where((F.col("r.rank") > F.col("before")) & (F.col("r.rank") <= F.col("upto"))).select(
        F.col("c").alias("_c"), F.col("_range").alias("_r"), "before", F.col("r.cid").alias("cid"), F.col("r.rank").alias("rank"))
    held = ranks.groupBy("_c", "_r").agg(F.first("before").alias("before"))
    near = ranged.join(held, (F.col("c") == F.col("_c")) & (F.col("_range") == F.col("_r"))).select("c", "_range", "before", "y", "x", "m")
    upto = Window.partitionBy("c", "_range").orderBy("y", "x").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("hi", F.col("before") + F.sum("m").over(upto)).withColumn("lo", F.col("hi") - F.col("m"))
    hit = near.join(ranks.select("_c", "_r", "cid", "rank"), (F.col("c") == F.col("_c")) & (F.col("_range") == F.col("_r"))
                    & (F.col("rank") > F.col("lo")) & (F.col("rank") <= F.col("hi")))
    return hit.select("c", "cid", F.col("x").alias("cx"), F.col("y").alias("cy"))


def _near(centers: Column) -> Column:
    """(squared distance, cid) of the nearest center; ties go to the lower cid."""
    unit = lambda d, s: F.when(F.col(s) > 0, d / F.col(s)).otherwise(F.lit(0.0))
    return F.array_min(F.transform(centers, lambda c: F.struct(
        (F.pow(unit(F.col("x") - c["cx"], "sp"), F.lit(2)) + F.pow(unit(F.col("y") - c["cy"], "ss"), F.lit(2))).alias("d"), c["cid"].alias("cid"))))


def _met(dealt: DataFrame, centers: DataFrame) -> DataFrame:
    """Every point once for each start of its category that is still moving, with that start's centers ``cs``."""
    per = centers.groupBy("c", "start").agg(F.sort_array(F.collect_list(F.struct("cid", "cx", "cy"))).alias("cs"))
    per = per.groupBy("c").agg(F.collect_list(F.struct("start", "cs")).alias("ss_"))
    per = per.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SHARES - 1))))
    return dealt.join(per, ["c", "share"]).select("c", "x", "y", "m", "sp", "ss", F.inline("ss_"))


def _clusters_over_tasks(points: DataFrame, k: int, starts: int) -> DataFrame:
    """CAT, cx, cy, inertia, first for points c, x, y, m, sp, ss of any number."""
    dealt = points.withColumn("share", F.pmod(F.xxhash64("x", "y"), F.lit(JOIN_SHARES)).cast("int")).repartition("c", "share")
    dealt = dealt.persist(StorageLevel.MEMORY_AND_DISK)      # dealt once for all steps; lost parts are dealt again from the written points
    try:
        every = points.groupBy("c").agg(F.least(F.sum("m"), F.lit(k)).alias("k")).withColumn(
            "start", F.explode(F.sequence(F.lit(1), F.lit(starts - 1)))) if starts > 1 else None
        centers = _rank_seeds(points, k).select("c", F.lit(0).alias("start"), "cid", "cx", "cy")
        if every is not None:
            drawn = None
            for turn in range(k):
                if turn:
                    met = _met(dealt, drawn).withColumn("near", _near(F.col("cs"))["d"])
                else:
                    share = every.select("c", "start").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SHARES - 1))))
                    met = dealt.join(share, ["c", "share"]).withColumn("near", F.lit(1.0))
                race = F.when(F.col("near") > 0, -F.ln(_uniform(F.col("start"), turn)) / (F.col("m") * F.col("near"))).otherwise(float("inf"))
                won = met.groupBy("c", "start").agg(F.min(F.struct(race.alias("race"), "x", "y")).alias("w"))
                won = won.join(every, ["c", "start"]).where(F.col("k") > turn).select(
                    "c", "start", F.lit(turn).alias("cid"), F.col("w.x").alias("cx"), F.col("w.y").alias("cy"))
                drawn = _written(won if drawn is None else drawn.unionByName(won), "kmeans-seeds")
            centers = centers.unionByName(drawn)
        centers = _written(centers.withColumn("last", F.lit(float("inf"))), "kmeans-centers")
        done = None
        while True:
            near = _near(F.col("cs"))
            sums = _met(dealt, centers).select("c", "start", "x", "y", "m", near.alias("n")).groupBy("c", "start", F.col("n.cid").alias("cid")).agg(
                (F.sum(F.col("m") * F.col("x")) / F.sum("m")).alias("mx"), (F.sum(F.col("m") * F.col("y")) / F.sum("m")).alias("my"),
                F.sum(F.col("n.d") * F.col("m")).alias("part"))
            step = centers.join(sums, ["c", "start", "cid"], "left")
            whole = Window.partitionBy(*_KEY)                # k rows each
            step = step.withColumn("inertia", F.sum("part").over(whole)).withColumn(
                "moved", F.max((F.coalesce("mx", "cx") != F.col("cx")) | (F.coalesce("my", "cy") != F.col("cy"))).over(whole))
            step = _written(step, "kmeans-centers")
            ends = ~(F.col("inertia") < F.col("last")) | ~F.col("moved")
            still = step.where(ends).select(*_KEY, "cid", "cx", "cy", F.least("inertia", "last").alias("inertia"))
            done = still if done is None else done.unionByName(still)
            centers = step.where(~ends).select(*_KEY, "cid", F.coalesce("mx", "cx").alias("cx"), F.coalesce("my", "cy").alias("cy"),
                                               F.col("inertia").alias("last"))
            if centers.isEmpty():
                break
        done = _written(done, "kmeans-ends")
    finally:
        dealt.unpersist()
    best = done.groupBy("c").agg(F.min(F.struct(F.round("inertia", 6), "start"))["start"].alias("start"),
                                 F.max(F.when(F.col("start") == 0, F.col("inertia"))).alias("first"))
    return done.join(best, ["c", "start"]).select(F.col("c").alias(CAT), "cx", "cy", "inertia", "first")


# ---- operator ----

def category_centers(points: DataFrame, scale: DataFrame, k: int = 3, starts: int = STARTS, in_task: int = IN_TASK) -> DataFrame:
    """CAT, cid, cx, cy, inertia (of the start kept) and first (inertia of start 0); cid counts from the lowest score up."""
    sizes = _written(points.groupBy(CAT).agg(F.count("*").alias("points")), "kmeans-sizes")
    sized = points.join(sizes, CAT).join(scale, CAT)
    u = F.array(*[_uniform(s, t) for s in range(1, starts) for t in range(k)]) if starts > 1 else F.array(F.lit(0.0))
    small = sized.where(F.col("points") <= in_task).select(CAT, "x", "y", "m", "sp", "ss", u.alias("u"))
    out = small.groupBy(CAT).applyInPandas(_clusters_in_task(k, starts), f"{CAT} string, cx double, cy double, inertia double, first double")
    if not sizes.where(F.col("points") > in_task).isEmpty():
        large = _written(sized.where(F.col("points") > in_task).select(F.col(CAT).alias("c"), "x", "y", "m", "sp", "ss"), "kmeans-large")
        out = out.unionByName(_clusters_over_tasks(large, k, starts))
    place = F.row_number().over(Window.partitionBy(CAT).orderBy("cy", "cx")) - 1
    return _written(out.withColumn("cid", place.cast("int")), "kmeans-centers")


def category_clusters(scored: DataFrame, k: int = 3, starts: int = STARTS, in_task: int = IN_TASK) -> DataFrame:
    """The catalog's rows with a category, and their cluster (cid); k = min(3, rows) in each category.

    Price and score are measured in the category's standard deviations.  A point goes to its
    nearest center, on ties to the lower cid; rows without price or score have no cluster and are left out.
    """
    rows = scored.where(F.col(CAT).isNotNull() & F.col("price").isNotNull() & F.col("demand_score").isNotNull())
    rows = rows.withColumn("x", F.col("price").cast("double")).withColumn("y", F.col("demand_score").cast("double"))
    points = _written(rows.groupBy(CAT, "x", "y").agg(F.count("*").alias("m")), "kmeans-points")
    scale = _written(rows.groupBy(CAT).agg(F.stddev_pop("x").alias("sp"), F.stddev_pop("y").alias("ss")), "kmeans-scale")
    centers = category_centers(points, scale, k, starts, in_task)
    by_cat = centers.groupBy(CAT).agg(F.sort_array(F.collect_list(F.struct("cid", "cx", "cy"))).alias("cs")).join(scale, CAT)
    met = join_by_share(rows, by_cat, CAT, "asin")
    return met.withColumn("cid", _near(F.col("cs"))["cid"]).drop("cs", "sp", "ss", "x", "y")

"""Hot keys: one category / class / asin holding most of the rows.

The operators must stay exact, and the plans must not route a hot group
through a single unbounded task (partial aggregation, WindowGroupLimit,
bucketed ranks)."""

from pyspark.sql import functions as F

from catalytics.operators import ranking as R
from catalytics.operators import sampling as SM
from catalytics.operators.catalog import score_catalog
from catalytics.operators.listings import TRAINING_COLUMNS
from catalytics.sources.readers import dedup_first
from helpers import rows

N = 30000


def skewed_catalog(spark):
    # 60% of rows in category "HOT", stars/bought skew most rows into one level
    return spark.range(N).select(
        F.col("id").alias("asin"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"),
        F.when(F.col("id") % 5 < 3, F.lit("HOT")).otherwise(F.concat(F.lit("C"), (F.col("id") % 40).cast("string")))
         .alias("categoryName"),
        (100.0 + (F.col("id") % 997) / 10.0).alias("price"),
        (F.col("id") % 1000).cast("bigint").alias("boughtInLastMonth"),
        F.when(F.col("id") % 11 == 0, F.lit(5.0)).otherwise(F.lit(1.5)).alias("stars"),
        (F.col("id") % 11 == 0).alias("isBestSeller"))


def test_bucketed_class_rank_exact_under_skew(spark):
    s = score_catalog(skewed_catalog(spark))
    r = SM.class_rank(s)
    per = rows(r.groupBy("demand_level").agg(F.count("*").alias("n"), F.min("r").alias("lo"),
                                              F.max("r").alias("hi"), F.countDistinct("r").alias("d")))
    assert max(x["n"] for x in per) > N / 3
    for x in per:
        assert x["lo"] == 1 and x["hi"] == x["n"] == x["d"]


def test_balance_exact_under_skew(spark):
    s = score_catalog(skewed_catalog(spark)).withColumn("is_user_product", F.lit(False)).select(*TRAINING_COLUMNS)
    before = {r["demand_level"]: r["count"] for r in rows(s.groupBy("demand_level").count())}
    after = {r["demand_level"]: r["count"] for r in rows(SM.balance_classes(s).groupBy("demand_level").count())}
    assert set(after.values()) == {max(before.values())}


def test_top_k_hot_category(spark):
    s = score_catalog(skewed_catalog(spark))
    top = R.category_top(s, 10)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    hot = [r for r in rows(top) if r["category"] == "HOT"]
    assert len(hot) == 10
    best = rows(s.where(F.col("categoryName") == "HOT")
                 .orderBy(F.col("demand_score").desc(), F.col("asin")).limit(10).select("asin"))
    assert [r["asin"] for r in sorted(hot, key=lambda r: r["rank"])] == [b["asin"] for b in best]


def test_dedup_hot_asin(spark):
    # a third of the rows are copies of asin 7; keep the lowest seq
    df = spark.range(N).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") + 100).alias("asin"),
                               F.col("id").alias("seq"), (F.col("id") * 2).alias("v"))
    d = dedup_first(df, "asin", "seq")
    assert d.count() == df.select("asin").distinct().count()
    assert rows(d.where(F.col("asin") == 7))[0]["seq"] == 0
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "partial" in plan.lower() or "ObjectHashAggregate" in plan or "SortAggregate" in plan

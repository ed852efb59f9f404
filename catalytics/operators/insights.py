"""Insight sentences of the analytics views, built from one-row results.

Every number is rounded first (``round_half`` / exact decimal means), so the
text formatting never rounds on its own and any engine renders the same
string.  Thousands separators use ``format_number(x, 0)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalytics.functions import scores as S
from catalytics.functions.scalars import with_row
from catalytics.operators import aggregates as A

# The insight sentence formats of the analytics views.
T_LEADER = "%s leads the catalog with %s products (%s%% share)."
T_TOP_SHARE = "Top %d categories account for %s%% of all listings."
T_SPAN = "Catalog spans %d distinct categories."
T_PRICE_HIGH = "%s carries the highest median price (₹%d)."
T_PRICE_LOW = "%s is the most affordable (median ₹%d)."
T_PRICE_MEAN = "Catalog-wide mean price: ₹%d."
T_HIGH_BUCKET = "%s products in the High-demand bucket (%s%%)."
T_LARGEST_TIER = "%s products sit at %s demand — the largest tier."
T_MEAN_SCORE = "Mean demand score across the catalog: %s."
T_CORR = "Price ↔ Rating correlation: %+.3f (%s)."
T_HIGH_RATED = "%s products carry a 4.5★+ rating."
T_SHOWING = "Showing %s of %s products (sample in md5 order)."
T_PEAK = "Peak month: %s with %s units sold."
T_GROWTH = "Trend from %s to %s: %+.1f%%."
T_Q4 = "Q4 (Oct–Dec) drives %s%% of annual volume."
T_STRONGEST = "Strongest pair: %s ↔ %s (r = %+.3f)."
T_WEAKEST = "Weakest pair: %s ↔ %s (r = %+.3f)."
T_COUPLING = "Demand score is engineered from price / rating / units — expect non-trivial coupling there."


def _n(c) -> Column:
    """Integer with thousands separators."""
    return F.format_number(S.col_(c).cast("bigint"), 0)


def _s(c) -> Column:
    """A rounded double as its shortest text (12.3, 40.0)."""
    return S.col_(c).cast("string")


def category_distribution_insights(scored: DataFrame, top: int = 12) -> DataFrame:
    s = A.category_distribution_summary(scored, top)
    return s.select(F.format_string(T_LEADER, "leader", _n("leader_count"), _s("leader_pct")).alias("insight_1"),
                    F.format_string(T_TOP_SHARE, F.lit(top), _s("top_share_pct")).alias("insight_2"),
                    F.format_string(T_SPAN, "distinct_categories").alias("insight_3"))


def price_distribution_insights(scored: DataFrame, top: int = 10) -> DataFrame:
    d = A.price_distribution(scored, top, ranked=True)
    high = d.orderBy("rank").limit(1).select(F.col("category").alias("hi_cat"),
                                             S.round_half("median", 0).cast("bigint").alias("hi_med"))
    low = (d.orderBy(F.col("rank").desc()).limit(1)
            .select(F.col("category").alias("lo_cat"), S.round_half("median", 0).cast("bigint").alias("lo_med")))
    mean = scored.agg(S.exact_avg("price", digits=0).cast("bigint").alias("mean_price"))
    return with_row(with_row(high, low), mean).select(
        F.format_string(T_PRICE_HIGH, "hi_cat", "hi_med").alias("insight_1"),
        F.format_string(T_PRICE_LOW, "lo_cat", "lo_med").alias("insight_2"),
        F.format_string(T_PRICE_MEAN, "mean_price").alias("insight_3"))


def demand_insights(scored: DataFrame) -> DataFrame:
    mix = A.demand_mix(scored)
    wide = mix.agg(F.max(F.when(F.col("level") == "High", F.col("count"))).alias("high"),
                   F.max(F.when(F.col("level") == "High", F.col("pct"))).alias("high_pct"),
                   F.max(F.struct("count", F.when(F.col("level") == "High", 2).when(F.col("level") == "Medium", 1).otherwise(0),
                                  "level")).alias("largest"))
    mean = scored.agg(S.exact_avg("demand_score", digits=1).alias("mean_score"))
    return with_row(wide, mean).select(
        F.format_string(T_HIGH_BUCKET, _n("high"), _s("high_pct")).alias("insight_1"),
        F.format_string(T_LARGEST_TIER, _n("largest.count"), "largest.level").alias("insight_2"),
        F.format_string(T_MEAN_SCORE, _s("mean_score")).alias("insight_3"))


def ratings_insights(scored: DataFrame, sample: int = 1200) -> DataFrame:
    r = A.price_rating_corr(scored)
    return r.select(F.format_string(T_CORR, "corr", "bucket").alias("insight_1"),
                    F.format_string(T_HIGH_RATED, _n("high_rated")).alias("insight_2"),
                    F.format_string(T_SHOWING, _n(F.least(F.lit(sample).cast("bigint"), F.col("total"))),
                                    _n("total")).alias("insight_3"))


def monthly_insights_text(monthly: DataFrame) -> DataFrame:
    ins = A.monthly_insights(monthly)
    span = monthly.agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    return with_row(ins, span).select(
        F.format_string(T_PEAK, "peak_month", _n("peak_units")).alias("insight_1"),
        F.format_string(T_GROWTH, "first_month", "last_month", "growth_pct").alias("insight_2"),
        F.format_string(T_Q4, _s("q4_share_pct")).alias("insight_3"))


def correlation_insights(scored: DataFrame) -> DataFrame:
    """Strongest / weakest pair by |r|; ties keep the pair order (stable sort)."""
    m = A.correlation_matrix(scored).where(F.col("i") < F.col("j"))
    key = F.struct(F.abs("r").alias("a"), (-(F.col("i") * 10 + F.col("j"))).alias("o"))
    key_weak = F.struct((-F.abs("r")).alias("a"), (F.col("i") * 10 + F.col("j")).alias("o"))
    pair = F.struct("row_label", "col_label", "r")
    p = m.agg(F.max_by(pair, key).alias("hi"), F.max_by(pair, key_weak).alias("lo"))
    return p.select(F.format_string(T_STRONGEST, "hi.row_label", "hi.col_label", "hi.r").alias("insight_1"),
                    F.format_string(T_WEAKEST, "lo.row_label", "lo.col_label", "lo.r").alias("insight_2"),
                    F.lit(T_COUPLING).alias("insight_3"))


# Sentence formats of the trend and category pages.
T_TOP5 = "Top 5 by demand: %s"
T_RECOMMEND = "Recommended: %s — best balance of demand score & sales volume"
T_CATEGORY = ("This category has %s products with an avg demand score of %s. "
              "%s products are High demand, %s are Best Sellers. ")
T_TOP_PRODUCT = "Top product: %s (score %s). "
T_HOT_SEGMENT = "Hot segment has %s products averaging ₹%s with score %s."


def js_number(c) -> Column:
    """A double as the browser prints a JSON number: 45.0 -> '45', 45.5 -> '45.5'."""
    x = S.col_(c)
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def trend_texts(trend_rows: DataFrame) -> DataFrame:
    """The trend page's two sentences from the recommendation row."""
    r = A.trend_recommendation(trend_rows)
    return r.select(F.format_string(T_TOP5, "top5").alias("top5_text"),
                    F.format_string(T_RECOMMEND, "recommended").alias("recommendation_text"))


def category_insights(scored: DataFrame) -> DataFrame:
    """The category page's insight sentence for every category (without the
    segment clause, which needs the KMeans segments; see ``with_hot_segment``)."""
    from catalytics.operators import ranking as R
    st = A.category_stats(scored)
    top = R.category_top(scored, 1).select("category", F.substring("title", 1, 50).alias("top_title"),
                                           F.col("demand_score").alias("top_score"))
    j = st.join(top, "category", "left")
    first = F.format_string(T_CATEGORY, F.col("product_count").cast("string"), js_number("avg_demand_score"),
                            F.col("high_demand_count").cast("string"), F.col("best_sellers").cast("string"))
    top_part = F.when(F.col("top_title").isNotNull(),
                      F.format_string(T_TOP_PRODUCT, "top_title", js_number("top_score"))).otherwise(F.lit(""))
    return j.select("category", F.concat(first, top_part).alias("insight"))


def with_hot_segment(insights: DataFrame, segment_summary: DataFrame) -> DataFrame:
    """Append the Hot-segment clause (segment_summary from A17)."""
    hot = (segment_summary.where(F.col("segment") == "Hot")
           .select(F.col("categoryName").alias("category"),
                   F.format_string(T_HOT_SEGMENT, F.col("count").cast("string"), js_number("avg_price"),
                                   js_number("avg_demand_score")).alias("_hot")))
    return (insights.join(hot, "category", "left")
                    .select("category", F.concat(F.col("insight"), F.coalesce("_hot", F.lit(""))).alias("insight")))

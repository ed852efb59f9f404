"""
blocks as DataFrames.

A ``Context`` is loaded once (like the reference's global frame): the scored
catalog and the other tables, optionally cached.  Parameters and their
allowed ranges follow the reference; a value out of range raises
``ValueError`` (the reference answers 422).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalytics.operators import aggregates as A
from catalytics.operators import changes as C
from catalytics.operators import insights as IN
from catalytics.operators import listings as L
from catalytics.operators import ml as M
from catalytics.operators import ranking as R
from catalytics.operators import sampling as SM
from catalytics.operators.catalog import score_catalog
from catalytics.sources import fixtures as X
from catalytics.sources import readers as RD


def _check(name: str, value, lo=None, hi=None):
    if value is None:
        return
    if (lo is not None and value < lo) or (hi is not None and value > hi):
        raise ValueError(f"{name} must be in [{lo}, {hi}], got {value}")


@dataclass
class Context:
    spark: SparkSession
    sf_dir: str
    catalog: DataFrame
    scored: DataFrame
    listings: DataFrame          # raw all-string seller listings

    @classmethod
    def load(cls, spark: SparkSession, sf_dir: str, cache: bool = False) -> "Context":
        catalog = X.catalog_base(spark, sf_dir)
        scored = score_catalog(catalog)
        listings = X.listings_raw(spark, sf_dir)
        if cache:
            scored, listings = scored.cache(), listings.cache()
        return cls(spark, sf_dir, catalog, scored, listings)


# ---------------------------------------------------------------- products
def list_products(ctx: Context, page: int = 1, limit: int = 20, search: str | None = None,
                  category: str | None = None, sort_by: str | None = None, min_price: float | None = None,
                  max_price: float | None = None, min_stars: float | None = None,
                  bestseller: bool | None = None) -> dict[str, DataFrame]:
    _check("page", page, 1)
    _check("limit", limit, 1, 10000)
    _check("min_price", min_price, 0)
    _check("max_price", max_price, 0)
    _check("min_stars", min_stars, 0, 5)
    f = dict(search=search, category=category, min_price=min_price, max_price=max_price, min_stars=min_stars,
             bestseller=bestseller)
    return {"data": R.product_listing(ctx.scored, ctx.listings, page=page, limit=limit, sort_by=sort_by, **f),
            "meta": R.product_listing_meta(ctx.scored, ctx.listings, page=page, limit=limit, **f)}


def get_product(ctx: Context, asin: int) -> DataFrame:
    keys = ctx.spark.range(1).select(F.lit(int(asin)).cast("bigint").alias("asin"))
    return L.product_lookup(ctx.scored, ctx.listings, keys)


def list_categories(ctx: Context) -> DataFrame:
    return R.categories(ctx.scored)


def recommended_products(ctx: Context, limit: int = 10) -> DataFrame:
    _check("limit", limit, 1, 50)
    return R.recommended(ctx.scored, limit)


def demand_prediction(ctx: Context, asin: int) -> DataFrame:
    keys = ctx.spark.range(1).select(F.lit(int(asin)).cast("bigint").alias("asin"))
    return L.demand_lookup(ctx.scored, ctx.catalog, ctx.listings, keys)


def dataset_stats(ctx: Context) -> DataFrame:
    return A.stats(ctx.scored)


def demand_trends(ctx: Context, top: int = 20, sort_by: str = "avg_demand_score") -> dict[str, DataFrame]:
    _check("top", top, 1, 126)
    t = A.trends(ctx.scored, top, ranked=True)
    return {"data": t.drop("rank"), "cards": A.trend_cards(t), "recommendation": A.trend_recommendation(t),
            "texts": IN.trend_texts(t), "chart": R.trends_resort(t, sort_by)}


def bulk_predictions(ctx: Context, limit: int = 50, category: str | None = None,
                     level: str | None = None) -> dict[str, DataFrame]:
    _check("limit", limit, 1, 200)
    p = R.predictions(ctx.scored, limit, category, level)
    return {"data": p, "summary": A.predictions_summary(p)}


def inventory_overview(ctx: Context, limit: int = 30) -> dict[str, DataFrame]:
    _check("limit", limit, 1, 100)
    return {"metrics": A.inventory_metrics(ctx.scored, limit), "reorder_alerts": R.reorder_alerts(ctx.scored, limit),
            "top_movers": R.top_movers(ctx.scored, limit), "categories": A.inventory_categories(ctx.scored, 15)}


def rf_predict(ctx: Context, model, requests: DataFrame) -> dict[str, DataFrame]:
    """Batch of prediction requests (price, stars, boughtInLastMonth,
    isBestSeller, categoryName); invalid rows come back with their reason."""
    req = requests.withColumn("asin", F.monotonically_increasing_id()) if "asin" not in requests.columns else requests
    from catalytics.functions.predicates import request_reason
    checked = req.withColumn("reject_reason", request_reason())
    return {"predictions": M.predict_demand(model, ctx.catalog, checked.where(F.col("reject_reason").isNull()).drop("reject_reason")),
            "rejected": checked.where(F.col("reject_reason").isNotNull())}


def model_stats(ctx: Context, max_iter: int = M.MAX_ITER) -> DataFrame:
    return M.model_stats(ctx.scored, max_iter)


def category_analysis(ctx: Context, category: str | None = None) -> dict[str, DataFrame]:
    """All blocks of the category view, for every category (or one)."""
    s = ctx.scored if category is None else ctx.scored.where(F.col("categoryName") == category)
    with_seg = M.label_segments(M.category_clusters(s))
    seg = with_seg.select("asin", "segment")
    return {"stats": A.category_stats(s), "cluster_summary": A.segment_summary(with_seg),
            "top_products": R.category_top(s, 10).join(seg.select("asin", "segment"), "asin", "left"),
            "bottom_products": R.category_bottom(s, 5).join(seg.select("asin", "segment"), "asin", "left"),
            "price_buckets": A.price_buckets(s), "stars_dist": A.stars_histogram(s),
            "scatter": SM.category_scatter(s, 300).join(seg.select("asin", "segment"), "asin", "left"),
            "bought_chart": R.category_bought_top(s, 10),
            "insight": IN.with_hot_segment(IN.category_insights(s), A.segment_summary(with_seg))}


# ---------------------------------------------------------------- analytics
def summary(ctx: Context) -> DataFrame:
    return A.summary(ctx.scored)


def category_distribution(ctx: Context, top: int = 12) -> dict[str, DataFrame]:
    _check("top", top, 3, 50)
    return {"data": A.category_distribution(ctx.scored, top),
            "insights": A.category_distribution_summary(ctx.scored, top),
            "insight_text": IN.category_distribution_insights(ctx.scored, top)}


def price_distribution(ctx: Context, top: int = 10) -> dict[str, DataFrame]:
    _check("top", top, 3, 30)
    return {"data": A.price_distribution(ctx.scored, top), "samples": SM.category_price_samples(ctx.scored, top),
            "insight_text": IN.price_distribution_insights(ctx.scored, top)}


def demand_analysis(ctx: Context) -> dict[str, DataFrame]:
    return {"pie": A.demand_mix(ctx.scored), "bubble": A.demand_bubble(ctx.scored, 15),
            "insight_text": IN.demand_insights(ctx.scored)}


def ratings_vs_price(ctx: Context, sample: int = 1200) -> dict[str, DataFrame]:
    _check("sample", sample, 100, 5000)
    return {"data": SM.scatter_sample(ctx.scored, sample), "insights": A.price_rating_corr(ctx.scored),
            "insight_text": IN.ratings_insights(ctx.scored, sample)}


def monthly_trend(ctx: Context) -> dict[str, DataFrame]:
    m = A.monthly_units(ctx.spark, ctx.sf_dir)
    return {"data": m, "insights": A.monthly_insights(m), "seasonal": A.seasonal_allocation(ctx.scored),
            "insight_text": IN.monthly_insights_text(m)}


def correlation(ctx: Context) -> dict[str, DataFrame]:
    return {"matrix": A.correlation_matrix(ctx.scored), "pairs": A.correlation_pairs(ctx.scored),
            "insight_text": IN.correlation_insights(ctx.scored)}


# ---------------------------------------------------------------- users, listings, orders, datasets
def user_products(ctx: Context, email: str) -> dict[str, DataFrame]:
    mine = ctx.listings.where(F.lower(F.col("owner_email")) == email.lower())
    return {"data": L.user_listings(ctx.listings, email), "panel": A.seller_panel(L.parse_listings(mine))}


def get_orders(ctx: Context, email: str) -> DataFrame:
    return L.user_orders(X.orders(ctx.spark, ctx.sf_dir, email), email)


def build_dataset(ctx: Context, save_path: str | None = None) -> dict[str, DataFrame]:
    training = L.training_union(ctx.catalog, ctx.listings)
    balanced = SM.balance_classes(training).drop("copy")
    if save_path:
        RD.write_table(balanced, save_path, fmt="csv")
    return {"data": balanced, "distribution": A.class_distribution(training),
            "info": RD.dataset_info(balanced)}


def db_status(ctx: Context) -> DataFrame:
    return RD.collection_counts({
        "products": ctx.catalog, "users": X.users(ctx.spark, ctx.sf_dir),
        "user_products": L.listing_view(ctx.listings), "orders": X.orders(ctx.spark, ctx.sf_dir),
        "gridfs_files": X.asset_manifest_rows(ctx.spark, ctx.sf_dir)})


def apply_changes(ctx: Context) -> dict[str, DataFrame]:
    """The change-log jobs of the seller and profile pages, over the fixture logs."""
    s, d = ctx.spark, ctx.sf_dir
    return {"listing_updates": C.listing_updates(ctx.listings, X.listing_updates_log(s, d)),
            "listing_deletes": C.listing_deletes(ctx.listings, X.listing_deletes_log(s, d)),
            "image_uploads": C.seller_activity_merge(ctx.listings, X.image_uploads_log(s, d)),
            "profiles": C.profile_updates(X.users(s, d), X.profile_updates_log(s, d)),
            "registrations": C.duplicate_registration(X.users(s, d), X.registrations_log(s, d)),
            "inserts": L.listing_inserts(ctx.catalog, ctx.listings, X.insert_batch(s, d))}

"""Every endpoint function runs and returns executable blocks; ranges are enforced."""

import pytest

from catalytics.plans import endpoints as EP
from helpers import SF_SMALL


@pytest.fixture(scope="module")
def ctx(spark):
    return EP.Context.load(spark, SF_SMALL, cache=True)


def _run(out):
    blocks = out.values() if isinstance(out, dict) else [out]
    for b in blocks:
        b.count()


@pytest.mark.parametrize("fn,kw", [
    (EP.list_products, dict(page=1, limit=5, search="red", sort_by="demand_desc")),
    (EP.get_product, dict(asin=3)), (EP.list_categories, {}), (EP.recommended_products, {}),
    (EP.demand_prediction, dict(asin=3)), (EP.dataset_stats, {}), (EP.demand_trends, {}),
    (EP.bulk_predictions, dict(level="Low")), (EP.inventory_overview, {}), (EP.category_analysis, {}),
    (EP.summary, {}), (EP.category_distribution, {}), (EP.price_distribution, {}), (EP.demand_analysis, {}),
    (EP.ratings_vs_price, {}), (EP.monthly_trend, {}), (EP.correlation, {}),
    (EP.user_products, dict(email="SUPPLIER#000000000")), (EP.get_orders, dict(email="Customer#000000001")),
    (EP.build_dataset, {}), (EP.db_status, {}), (EP.apply_changes, {}),
])
def test_endpoint_runs(ctx, fn, kw):
    _run(fn(ctx, **kw))


def test_ranges_enforced(ctx):
    with pytest.raises(ValueError):
        EP.list_products(ctx, limit=0)
    with pytest.raises(ValueError):
        EP.demand_trends(ctx, top=127)
    with pytest.raises(ValueError):
        EP.ratings_vs_price(ctx, sample=50)


def test_get_product_listing_precedence(ctx):
    from pyspark.sql import functions as F
    lst_asin = ctx.listings.select(F.col("asin").cast("bigint")).first()[0]
    r = EP.get_product(ctx, lst_asin).collect()
    assert len(r) == 1 and r[0]["is_user_product"] is True
    assert EP.get_product(ctx, -5).count() == 0


def test_rf_predict_validates_and_scores(ctx, spark):
    from catalytics.operators import ml as M
    model, _ = M.train_demand_model(ctx.scored, max_iter=5)
    req = spark.createDataFrame(
        [(1, 950.0, 4.5, 120, True, "Brand#1"), (2, 0.0, 4.0, 10, False, "Brand#2"),
         (3, 940.0, 6.0, 10, False, "Brand#3"), (4, 930.0, 3.0, 5, False, "never seen")],
        "asin long, price double, stars double, boughtInLastMonth long, isBestSeller boolean, categoryName string")
    out = EP.rf_predict(ctx, model, req)
    pred = {r["asin"]: r for r in out["predictions"].collect()}
    rej = {r["asin"]: r["reject_reason"] for r in out["rejected"].collect()}
    assert set(pred) == {1, 4} and rej == {2: "price must be > 0", 3: "stars must be between 1 and 5"}
    assert pred[4]["demand_level"] in ("High", "Medium", "Low")       # unseen category encodes to 0

"""Hand-made edge frames (FIXTURES.md): the quirks of the reference's semantics."""

import pytest
from pyspark.sql import functions as F

from catalytics.functions import predicates as P
from catalytics.functions import scores as S
from catalytics.operators import aggregates as A
from catalytics.operators import listings as L
from catalytics.operators import ranking as R
from catalytics.operators.catalog import score_catalog
from catalytics.sources.readers import CATALOG_SCHEMA, LISTING_SCHEMA
from helpers import rows

COLS = ["asin", "title", "categoryName", "price", "boughtInLastMonth", "stars", "isBestSeller"]


def cat(spark, data):
    return spark.createDataFrame([dict(zip(COLS, r)) for r in data], CATALOG_SCHEMA)


def lst(spark, data):
    names = [f.name for f in LISTING_SCHEMA.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in data], LISTING_SCHEMA)


BASE = [
    (1, "red widget", "A", 100.0, 10, 4.0, False),
    (2, "blue bolt", "A", 200.0, 20, 5.0, True),
    (3, "hot anvil", "B", 300.0, 0, 1.0, False),
    (4, None, "B", 150.0, 5, 3.0, False),
    (5, "red gizmo", None, 250.0, 7, 2.0, False),
]


def test_empty_catalog(spark):
    s = score_catalog(cat(spark, []))
    assert s.count() == 0
    st = rows(A.stats(s))[0]
    assert st["total_products"] == 0 and st["best_sellers"] == 0 and st["avg_price"] is None
    mix = rows(A.demand_mix(s))
    assert [m["level"] for m in mix] == ["High", "Medium", "Low"]
    assert all(m["count"] == 0 and m["pct"] == 0.0 for m in mix)


def test_one_product_and_equal_prices(spark):
    s = rows(score_catalog(cat(spark, [(1, "x", "A", 10.0, 0, 5.0, True)])))[0]
    # price_norm 50 when min == max, bought_norm 0 when max bought is 0
    assert s["price_norm"] == 50.0 and s["bought_norm"] == 0.0
    assert s["demand_score"] == round((100 + 0 + 100 + 50) * 0.25, 2)
    assert s["demand_level"] == "High"


def test_score_formula_and_levels(spark):
    s = {r["asin"]: r for r in rows(score_catalog(cat(spark, BASE)))}
    # asin 2: stars 5 -> 100, bought 20/20 -> 100, bestseller 100, price 200 of [100, 300] -> 50
    assert s[2]["demand_score"] == 87.5 and s[2]["demand_level"] == "High"
    # asin 3: stars 1 -> 0, bought 0, price 300 is max -> 0 => score 0
    assert s[3]["demand_score"] == 0.0 and s[3]["demand_level"] == "Low"
    assert s[1]["stars_norm"] == 75.0 and s[1]["price_norm"] == 100.0


def test_level_and_trend_boundaries(spark):
    df = spark.createDataFrame([(35.0,), (34.99,), (50.0,), (60.0,), (59.99,)], "s double")
    out = rows(df.select("s", S.demand_level("s").alias("lvl"), S.trend_label("s").alias("tr"),
                         S.trend_label("s", S.TREND_CUTS_LEGACY).alias("legacy")))
    got = {r["s"]: (r["lvl"], r["tr"], r["legacy"]) for r in out}
    assert got[35.0] == ("Medium", "Stable", "Declining")
    assert got[34.99] == ("Low", "Declining", "Declining")
    assert got[50.0] == ("Medium", "Rising", "Declining")
    assert got[60.0] == ("High", "Surging", "Declining")
    assert got[59.99] == ("Medium", "Rising", "Declining")


def test_round_half_uses_binary_value(spark):
    df = spark.createDataFrame([(32.925,), (2.675,), (0.125,), (1.005,)], "x double")
    got = [r[0] for r in df.select(S.round_half("x", 2)).collect()]
    # rounding of the double product x*100 (as numpy and DuckDB do): 32.925*100 and
    # 1.005*100 land below .5, 2.675*100 rounds to exactly 267.5, 0.125*100 is exact
    assert got == [32.92, 2.68, 0.13, 1.0]


def test_null_title_never_matches_and_null_category_not_grouped(spark):
    s = score_catalog(cat(spark, BASE))
    hits = {r["asin"] for r in rows(s.where(P.search_regex("red")))}
    assert hits == {1, 5}
    assert 4 not in {r["asin"] for r in rows(s.where(P.search_regex(".")))}
    cats = {r["category"] for r in rows(A.category_stats(s))}
    assert cats == {"A", "B"}
    assert rows(R.categories(s))[0]["count"] == 2


def test_regex_special_characters(spark):
    s = score_catalog(cat(spark, [(1, "a.b (x)", "A", 1.0, 0, 3.0, False), (2, "ab x", "A", 2.0, 0, 3.0, False)]))
    # regex search: '.' matches any character
    assert {r["asin"] for r in rows(s.where(P.search_regex("a.b")))} == {1}
    # literal search: '(' is just a character
    assert {r["asin"] for r in rows(s.where(P.search_literal("(X)")))} == {1}


def test_no_bestseller_recommends_all(spark):
    data = [(i, f"t{i}", "A", float(i), i, 3.0, False) for i in range(1, 6)]
    rec = rows(R.recommended(score_catalog(cat(spark, data)), 3))
    assert len(rec) == 3


def test_ties_broken_by_asin(spark):
    data = [(i, "same", "A", 10.0, 5, 3.0, False) for i in (9, 3, 7, 1)]
    top = [r["asin"] for r in rows(R.predictions(score_catalog(cat(spark, data)), 2))]
    assert top == [1, 3]


def test_level_filter_after_limit(spark):
    s = score_catalog(cat(spark, BASE))
    top2 = rows(R.predictions(s, 2))
    only_low = rows(R.predictions(s, 2, level="Low"))
    assert len(only_low) == sum(1 for r in top2 if r["demand_level"] == "Low")


def test_price_buckets_edges_and_max_excluded(spark):
    data = [(1, "a", "A", 0.0, 0, 3.0, False), (2, "b", "A", 20.0, 0, 3.0, False),
            (3, "c", "A", 40.0, 0, 3.0, False), (4, "d", "A", 100.0, 0, 3.0, False)]
    b = {r["bucket"]: r for r in rows(A.price_buckets(score_catalog(cat(spark, data))))}
    assert [b[i]["count"] for i in range(5)] == [1, 1, 1, 0, 0]      # 100 (the max) is in no bucket
    assert b[1]["label"] == "₹20-40"
    one = rows(A.price_buckets(score_catalog(cat(spark, [(1, "a", "A", 5.0, 0, 3.0, False)]))))
    assert [r["count"] for r in sorted(one, key=lambda r: r["bucket"])] == [1, 0, 0, 0, 0]   # width 1


def test_stars_histogram_keeps_zero_buckets(spark):
    h = rows(A.stars_histogram(score_catalog(cat(spark, [(1, "a", "A", 1.0, 0, 5.0, False)]))))
    assert {r["stars"]: r["count"] for r in h} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


def test_listing_parsing_rules(spark):
    raw = lst(spark, [
        {"asin": "10", "id": "1", "owner_email": "A@X.com", "title": "ok", "categoryName": "A", "price": "5.5",
         "stars": "4.0", "boughtInLastMonth": "3", "isBestSeller": "true"},
        {"asin": "11", "id": "", "owner_email": "b@x.com", "title": "blank id", "categoryName": "A", "price": "1",
         "stars": "1", "boughtInLastMonth": "1", "isBestSeller": "FALSE"},
        {"asin": "12", "id": "3", "owner_email": "c@x.com", "title": "bad price", "categoryName": "A",
         "price": "abc", "stars": "1", "boughtInLastMonth": "1", "isBestSeller": "FALSE"},
        {"asin": "13", "id": "4", "owner_email": "d@x.com", "title": "stars 6", "categoryName": "A", "price": "2",
         "stars": "6", "boughtInLastMonth": "1", "isBestSeller": None},
        {"asin": "14", "id": "5", "owner_email": "e@x.com", "title": "stars 0", "categoryName": "A", "price": "2",
         "stars": "0", "boughtInLastMonth": None, "isBestSeller": "FALSE"},
    ])
    view = {r["asin"]: r for r in rows(L.listing_view(raw))}
    assert 12 not in view                       # unparsable price drops the row
    assert view[10]["isBestSeller"] is True and view[10]["owner_email"] == "a@x.com"
    assert view[14]["boughtInLastMonth"] == 0   # missing -> default
    migrated = {r["asin"] for r in rows(L.scan_seller_listings(raw))}
    assert 11 not in migrated                   # blank id skipped by the migration read
    reasons = {r["asin"]: r["reject_reason"] for r in rows(L.validate_listings(raw))}
    assert reasons[10] is None
    assert reasons[13] == reasons[14] == "stars must be between 1 and 5"


def test_duplicate_listing_asin_first_id_wins(spark):
    raw = lst(spark, [
        {"asin": "50", "id": "2", "owner_email": "x@x", "title": "second", "categoryName": "A", "price": "1",
         "stars": "3", "boughtInLastMonth": "0", "isBestSeller": "FALSE"},
        {"asin": "50", "id": "1", "owner_email": "x@x", "title": "first", "categoryName": "A", "price": "1",
         "stars": "3", "boughtInLastMonth": "0", "isBestSeller": "FALSE"},
    ])
    s = score_catalog(cat(spark, BASE))
    keys = spark.createDataFrame([(50,), (1,), (999,)], "asin long")
    got = {r["asin"]: r for r in rows(L.product_lookup(s, raw, keys))}
    assert got[50]["title"] == "first" and got[50]["is_user_product"] is True
    assert got[1]["is_user_product"] is False and 999 not in got


def test_mixed_case_email(spark):
    raw = lst(spark, [{"asin": "1", "id": "1", "owner_email": "Seller@Shop.COM", "title": "t", "categoryName": "A",
                       "price": "1", "stars": "3", "boughtInLastMonth": "0", "isBestSeller": "FALSE"}])
    assert L.user_listings(raw, "SELLER@shop.com").count() == 1


def test_seller_panel_js_parsing(spark):
    raw = lst(spark, [
        {"asin": "1", "id": "1", "owner_email": "o@x", "title": "t", "categoryName": "A", "price": "99.9abc",
         "stars": "4.5x", "boughtInLastMonth": "1200 units", "isBestSeller": "FALSE"},
        {"asin": "2", "id": "2", "owner_email": "o@x", "title": "t", "categoryName": "A", "price": "x",
         "stars": "", "boughtInLastMonth": "abc", "isBestSeller": "FALSE"},
    ])
    r = rows(A.seller_panel(L.parse_listings(raw)))[0]
    # listing 1: 4.5/5*30 + 1*40 + 10 = 77; listing 2: 0 + 0 + 10 = 10
    assert r["listings"] == 2 and r["high_count"] == 1 and r["avg_score"] == 44 and r["avg_price"] == 49


def test_missing_demand_level_balancing(spark):
    from catalytics.operators.sampling import balance_classes
    from catalytics.operators.listings import TRAINING_COLUMNS
    data = [(i, f"t{i}", "A", 10.0, 0, 3.0, False) for i in range(7)] + \
           [(100 + i, "hi", "A", 1.0, 9, 5.0, True) for i in range(3)]
    s = score_catalog(cat(spark, data)).withColumn("is_user_product", F.lit(False)).select(*TRAINING_COLUMNS)
    counts = {r["demand_level"]: r["count"] for r in rows(balance_classes(s).groupBy("demand_level").count())}
    assert len(counts) == 2 and len(set(counts.values())) == 1 and max(counts.values()) == 7


def test_excluded_terms(spark):
    df = spark.createDataFrame([("1", "Sports Bra", "A"), ("2", "Brass lamp", "A"), ("3", None, "A"),
                                ("4", "a bra.", "A")], "asin string, title string, categoryName string")
    assert {r["asin"] for r in rows(P.excluded_terms(df))} == {"2"}


def test_means_keep_small_values(spark):
    df = spark.createDataFrame([(0.004,)] * 3 + [(None,)], "v double")
    got = df.agg(S.exact_mean("v").alias("m"), S.exact_avg("v", digits=4).alias("a")).first()
    assert float(got["m"]) == 0.004 and got["a"] == 0.004


def test_means_of_huge_and_tiny_values(spark):
    """Against fractions: prices of 10^12 beside 10^-9, values that a decimal cannot hold, and no value at all."""
    import random
    from fractions import Fraction
    rng = random.Random(4)
    data = [("big", 1e12 + rng.randint(0, 99) / 100) for _ in range(500)] + [("small", rng.randint(1, 9) * 1e-9) for _ in range(50)]
    data += [("two", 2e9), ("two", 1.0), ("far", 1e18), ("far", 3e18), ("none", None), ("nan", float("nan")), ("beyond", 1e300)]
    data += [("half", 0.005), ("half", 0.005)]
    got = {r["k"]: r for r in rows(spark.createDataFrame(data, "k string, v double").repartition(7).groupBy("k").agg(
        S.exact_mean("v").alias("m"), S.exact_avg("v").alias("a"), S.exact_sum("v").alias("s")))}
    for k in ("big", "small", "two", "half"):
        values = [Fraction(str(v)) for key, v in data if key == k]
        assert abs(Fraction(got[k]["m"]) - sum(values) / len(values)) <= Fraction(1, 10 ** 12)
    assert got["half"]["a"] == 0.01 and got["two"]["a"] == 1000000000.5 and got["far"]["a"] == 2e18 and got["far"]["s"] == 4e18
    assert got["none"]["m"] is None and got["nan"]["a"] is None and got["beyond"]["a"] is None


def test_range_row_number_with_an_outlier(spark):
    from catalytics.operators.ranking import range_row_number
    seqs = [*range(0, 400, 3), 10 ** 15, -7]
    got = rows(range_row_number(spark.createDataFrame([(s, "x") for s in seqs], "seq long, t string").repartition(5), ["seq"]))
    assert {r["seq"]: r["rn"] for r in got} == {s: i + 1 for i, s in enumerate(sorted(seqs))}
    assert rows(range_row_number(spark.createDataFrame([], "seq long, t string"), ["seq"])) == []


def test_exact_quantiles_equal_pandas(spark):
    import random
    import pandas as pd
    from catalytics.operators.quantiles import exact_quantiles
    rng = random.Random(2)
    data = [(i, "ab"[i % 2], rng.choice([1.0, 2.5, 2.5, 9.0, rng.random() * 100])) for i in range(501)]
    data += [(900, "c", 7.0), (901, "d", 1.0), (902, "d", 1.0), (903, "e", None), (904, None, 1.0)]
    df = spark.createDataFrame(data, "asin long, k string, v double")
    qs = (0.25, 0.5, 0.75, 0.0, 1.0)
    got = {r["k"]: r["q"] for r in rows(exact_quantiles(df, "k", "v", qs, ranges=7))}
    expected = pd.DataFrame(data, columns=["i", "k", "v"]).dropna().groupby("k")["v"].quantile(list(qs))
    assert set(got) == {"a", "b", "c", "d"}
    for k, q in got.items():
        assert q == pytest.approx(expected[k].tolist())


def test_pages_by_key_reach_every_row(spark):
    """Null prices, listings and filters: the keyset pages put together are the whole list."""
    from catalytics.operators import ranking as R
    data = [(i, f"t{i}", "A", None if i % 4 == 0 else float(i % 5), 3, 3.0, False) for i in range(30)]
    s = score_catalog(cat(spark, data))
    raw = lst(spark, [{"asin": str(50 + i), "id": str(i), "owner_email": "x@x", "title": "l", "categoryName": "A", "price": "1",
                       "stars": "3", "boughtInLastMonth": "0", "isBestSeller": "FALSE"} for i in range(5)])
    for sort_by in ("price_asc", "price_desc", None):
        whole = [r["asin"] for r in rows(R.product_listing(s, raw, limit=100, sort_by=sort_by, category="A"))]
        page, seen = rows(R.product_listing(s, raw, limit=7, sort_by=sort_by, category="A")), []
        last_id = {50 + i: i for i in range(5)}
        while page:
            seen += [r["asin"] for r in page]
            r = page[-1]
            key = (r["is_user_product"], last_id.get(r["asin"]) if r["is_user_product"] else None, r["price"], r["asin"])
            page = rows(R.product_listing_after(s, raw, key, sort_by=sort_by, limit=7, category="A"))
        assert seen == whole and len(seen) == 35


def test_invalid_edits_and_inserts_are_refused(spark):
    import datetime as dt
    from catalytics.operators import changes as C
    raw = lst(spark, [{"asin": "50", "id": "1", "owner_email": "x@x", "title": "t", "categoryName": "A", "price": "10",
                       "stars": "3", "boughtInLastMonth": "0", "isBestSeller": "FALSE"}])
    t = dt.datetime(2024, 1, 1)
    edits = spark.createDataFrame([(1, "x@x", t, None, None, 0.0, None, None, None, None), (1, "x@x", t + dt.timedelta(1), None, None, 12.0, None, None, None, None),
                                   (1, "x@x", t + dt.timedelta(2), " ", None, 99.0, None, None, None, None), (1, "x@x", t + dt.timedelta(3), None, None, 99.0, 7.0, None, None, None)],
                                  "id long, owner_email string, ts timestamp, title string, categoryName string, price double, stars double, "
                                  "boughtInLastMonth long, isBestSeller boolean, description string")
    assert [(r["price"], r["title"], r["stars"]) for r in rows(C.listing_updates(raw, edits))] == [(12.0, "t", 3.0)]
    batch = spark.createDataFrame([(1, "o@x", "t", "A", 5.0, 3.0, 1, False, "d"), (2, "o@x", "t", "A", 0.0, 3.0, 1, False, "d"), (3, "o@x", "t", "A", 6.0, 3.0, 1, False, "d")],
                                  "seq long, owner_email string, title string, categoryName string, price double, stars double, "
                                  "boughtInLastMonth long, isBestSeller boolean, description string")
    got = rows(L.listing_inserts(cat(spark, BASE), raw, batch))
    assert sorted((r["id"], r["price"]) for r in got) == [(2, 5.0), (3, 6.0)]


def test_trend_order_is_kept_among_equal_rounded_means(spark):
    """Z is ahead of A by an exact mean that rounds to the same two decimals."""
    df = spark.createDataFrame([(1, "Z", 50.004), (2, "A", 50.001), (3, "B", 10.0)], "asin long, categoryName string, demand_score double")
    s = df.select("*", F.lit(3.0).alias("stars"), F.lit(1.0).alias("price"), F.lit(5).cast("bigint").alias("boughtInLastMonth"), F.lit(False).alias("isBestSeller"))
    t = A.trends(s, 20, ranked=True)
    assert rows(A.trend_recommendation(t))[0] == {"recommended": "Z", "composite": 35.0015, "top5": "Z, A, B"}
    from catalytics.operators import ranking as R
    assert [r["category"] for r in rows(R.trends_resort(t, "total_bought"))] == ["Z", "A", "B"]


def test_requests_without_a_category_are_accepted(spark):
    df = spark.createDataFrame([(1.0, 3.0, 0), (0.0, 3.0, 0), (1.0, 6.0, 0), (1.0, 3.0, -1)], "price double, stars double, boughtInLastMonth long")
    assert [r["x"] for r in rows(df.select(P.request_reason().alias("x")))] == [
        None, "price must be > 0", "stars must be between 1 and 5", "boughtInLastMonth must be >= 0"]

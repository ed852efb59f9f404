"""Property tests against brute force on small generated fixtures."""

import math
import re

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalytics.functions import predicates as P
from catalytics.functions import scores as S
from catalytics.operators import aggregates as A
from catalytics.operators import ranking as R
from catalytics.operators import sampling as SM
from catalytics.operators.catalog import score_catalog
from catalytics.operators.listings import TRAINING_COLUMNS
from catalytics.sources.readers import CATALOG_SCHEMA

FAST = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
prices = st.lists(st.integers(min_value=0, max_value=20000).map(lambda c: c / 100.0), min_size=1, max_size=40)


def _catalog(spark, cat_prices):
    rows, asin = [], 0
    for cat, ps in cat_prices.items():
        for p in ps:
            asin += 1
            rows.append((asin, f"t{asin}", cat, p, asin % 7, 1.0 + (asin % 41) / 10.0, asin % 5 == 0))
    cols = ["asin", "title", "categoryName", "price", "boughtInLastMonth", "stars", "isBestSeller"]
    return spark.createDataFrame([dict(zip(cols, r)) for r in rows], CATALOG_SCHEMA)


@FAST
@given(st.dictionaries(st.sampled_from(["A", "B", "C"]), prices, min_size=1))
def test_price_buckets_match_reference_loop(spark, cat_prices):
    got = {(r["category"], r["bucket"]): r["count"]
           for r in A.price_buckets(score_catalog(_catalog(spark, cat_prices))).collect()}
    for cat, ps in cat_prices.items():
        pmin, pmax = min(ps), max(ps)
        size = (pmax - pmin) / 5 if pmax > pmin else 1
        for i in range(5):
            lo, hi = pmin + i * size, pmin + (i + 1) * size
            assert got[(cat, i)] == sum(1 for p in ps if lo <= p < hi)


@FAST
@given(st.lists(st.tuples(st.sampled_from(["x", "y"]), st.integers(0, 10 ** 6)), min_size=1, max_size=60,
                unique_by=lambda t: t[1]))
def test_bucketed_rank_equals_global_rank(spark, data):
    df = spark.createDataFrame(data, "g string, k long")
    got = R.bucketed_row_number(df, ["g"], F.substring(F.md5(F.col("k").cast("string")), 1, 1),
                                [F.md5(F.col("k").cast("string")), F.col("k")], out="r")
    w = Window.partitionBy("g").orderBy(F.md5(F.col("k").cast("string")), "k")
    want = df.withColumn("r", F.row_number().over(w))
    assert sorted(map(tuple, got.select("g", "k", "r").collect())) == \
        sorted(map(tuple, want.select("g", "k", F.col("r").cast("long")).collect()))


@FAST
@given(st.lists(st.integers(1, 25), min_size=1, max_size=3))
def test_balance_gives_every_class_the_majority_count(spark, sizes):
    levels = ["High", "Medium", "Low"]
    rows, asin = [], 0
    for lvl, n in zip(levels, sizes):
        for _ in range(n):
            asin += 1
            rows.append((asin, "t", "A", 1.0, 0, 3.0, False, 1.0, lvl, 0.0, 0.0, 0.0, 0.0, False))
    schema = ("asin long, title string, categoryName string, price double, boughtInLastMonth long, "
              "stars double, isBestSeller boolean, demand_score double, demand_level string, stars_norm double, "
              "bought_norm double, bs_norm double, price_norm double, is_user_product boolean")
    df = spark.createDataFrame(rows, schema).select(*TRAINING_COLUMNS)
    got = dict(SM.balance_classes(df).groupBy("demand_level").count().collect())
    assert got == {lvl: max(sizes) for lvl in levels[:len(sizes)]}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(min_value=0, max_value=1e6, allow_nan=False), min_size=1, max_size=200))
def test_round_half_agrees_with_numpy_except_exact_halves(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(S.round_half("x", 2)).collect()]
    for x, g in zip(xs, got):
        scaled = x * 100.0
        if scaled - math.floor(scaled) != 0.5:
            assert g == np.round(x, 2) or math.isclose(g, float(np.round(x, 2)), rel_tol=0, abs_tol=1e-9)


def _js_float(s):
    m = re.match(r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", s or "")
    return float(m.group(1)) if m else 0.0


def _js_int(s):
    m = re.match(r"^\s*([+-]?\d+)", s or "")
    return int(m.group(1)) if m else 0


@FAST
@given(st.lists(st.text(alphabet="0123456789.-+eE abc", max_size=8), min_size=1, max_size=30))
def test_js_number_parsing(spark, strings):
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    got = df.select(P.js_parse_float("s").alias("f"), P.js_parse_int("s").alias("i")).collect()
    for s, r in zip(strings, got):
        assert r["f"] == _js_float(s) and r["i"] == _js_int(s)

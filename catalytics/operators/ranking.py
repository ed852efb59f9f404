"""Ordering, top-k, paging and per-group ranking.

* Global top-k is ``orderBy(...).limit(k)``: Spark plans it as
  ``TakeOrderedAndProject`` (each task keeps k rows, no full sort).
* Top-k per group is ``row_number() <= k`` over a partitioned window: Spark
  inserts a partial ``WindowGroupLimit`` before the shuffle, so a category
  holding a third of the rows ships only k rows per input partition.
* Every sort ends with a unique key (asin or name) so ties are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalytics.functions.scalars import with_row
from catalytics.functions import scores as S
from catalytics.session import scratch_path
from catalytics.functions.predicates import catalog_filter, reorder_predicate

CAT = "categoryName"

# The product-list sort options (column, ascending).
SORT_OPTIONS = {
    "price_asc": ("price", True),
    "price_desc": ("price", False),
    "rating_desc": ("stars", False),
    "demand_desc": ("demand_score", False),
    "popular_desc": ("boughtInLastMonth", False),
}


def md5_key(c="asin") -> Column:
    """Deterministic pseudo-random order key (same value in any SQL engine)."""
    return F.md5(F.col(c).cast("string"))


def top_per_group(df: DataFrame, group: str | list, order: list[Column], k: int,
                  rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each group (row_number, deterministic order)."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def bucketed_row_number(df: DataFrame, group: list[str], bucket: Column, order: list[Column],
                        out: str = "rn", bucket_bound: int | None = None) -> DataFrame:
    """Exact row_number within ``group`` by ``order`` without one task per group.

    ``bucket`` must be monotone in ``order`` (e.g. a prefix of the md5 order
    key).  Ranks are: rows of the group in lower buckets (a small per-bucket
    count table, cumulated) + row_number within (group, bucket).  The window
    then runs on (group, bucket) slices, so a group holding a third of all
    rows is spread over as many tasks as it has buckets.  ``bucket_bound`` is
    the known number of buckets per group; when given, the count table is
    broadcast (its size is groups x bucket_bound).
    """
    d = df.withColumn("_bkt", bucket)
    counts = d.groupBy(*group, "_bkt").agg(F.count("*").alias("_n"))
    cw = Window.partitionBy(*group).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(cw), F.lit(0).cast("bigint"))).drop("_n")
    if bucket_bound is not None:
        offsets = F.broadcast(offsets)
    w = Window.partitionBy(*group, "_bkt").orderBy(*order)
    return (d.withColumn("_local", F.row_number().over(w))
             .join(offsets, [*group, "_bkt"])
             .withColumn(out, F.col("_off") + F.col("_local"))
             .drop("_bkt", "_local", "_off"))


def range_row_number(df: DataFrame, order: list[str], out: str = "rn") -> DataFrame:
    """Row number over the whole frame in the order of the given columns (together unique).

    Rows are range-partitioned by sampled quantiles and written, so that the ranges stay as
    they are; each range is numbered by itself, behind the rows of the ranges before it.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    path, schema = scratch_path(spark, "ranges"), ranged.schema
    ranged.write.parquet(path)
    ranged = spark.read.schema(schema).parquet(path)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_off")))      # one row per range
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_local", local).join(offsets, "_range").withColumn(out, F.col("_off") + F.col("_local")).drop("_range", "_local", "_off")


def md5_bucket(c="asin", hex_digits: int = 3) -> Column:
    """First hex digits of md5(asin): 16**hex_digits buckets, monotone in md5 order."""
    return F.substring(md5_key(c), 1, hex_digits)


# ---------------------------------------------------------------- T1 listing
def product_listing(scored: DataFrame, listings: DataFrame, page: int = 1, limit: int = 20,
                    search: str | None = None, category: str | None = None,
                    sort_by: str | None = None, min_price: float | None = None,
                    max_price: float | None = None, min_stars: float | None = None,
                    bestseller: bool | None = None) -> DataFrame:
    """One page of the product list: listings first (by id), then catalog
    rows in the requested order.  ``listings`` is the parsed listing table.

    Catalog rows are searched by regex, listings by literal substring, as in
    the reference.  Paging is ``orderBy + offset + limit`` (a bounded
    top-(offset+limit) per task); see ``product_listing_after`` for deep pages.
    """
    union = listing_union(scored, listings, search, category, min_price, max_price, min_stars, bestseller)
    order = listing_order(sort_by)
    start = (page - 1) * limit
    return union.orderBy(*order).offset(start).limit(limit).drop("_src", "_lid")


def listing_union(scored: DataFrame, listings: DataFrame, search=None, category=None, min_price=None,
                  max_price=None, min_stars=None, bestseller=None) -> DataFrame:
    """Filtered listings (literal search, quick score) + filtered catalog rows
    (regex search, stored score) in one frame; ``_src``/``_lid`` order them."""
    from catalytics.operators.listings import listing_view
    cat = (scored.where(catalog_filter(search, category, min_price, max_price, min_stars, bestseller))
                 .select("asin", "title", CAT, "price", "stars", "boughtInLastMonth", "isBestSeller",
                         "demand_score", F.lit(False).alias("is_user_product"),
                         F.lit("").alias("image_filename"),
                         F.lit(None).cast("string").alias("owner_email"),
                         F.lit(None).cast("string").alias("description"),
                         F.lit(None).cast("string").alias("added_on"),
                         F.lit(1).alias("_src"), F.lit(None).cast("bigint").alias("_lid")))
    lst = listing_view(listings).where(
        catalog_filter(search, category, min_price, max_price, min_stars, bestseller, literal=True))
    lst = lst.select("asin", "title", CAT, "price", "stars", "boughtInLastMonth", "isBestSeller",
                     S.quick_score().alias("demand_score"), F.lit(True).alias("is_user_product"),
                     "image_filename", "owner_email", "description", "added_on",
                     F.lit(0).alias("_src"), F.col("id").alias("_lid"))
    return lst.unionByName(cat)


def listing_order(sort_by: str | None) -> list[Column]:
    """Listings first by id; catalog rows by the sort option (nulls last), asin last."""
    order = [F.col("_src").asc(), F.col("_lid").asc_nulls_last()]
    if sort_by in SORT_OPTIONS:
        c, asc = SORT_OPTIONS[sort_by]
        order.append(F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last())
    order.append(F.col("asin").asc())
    return order


def product_listing_meta(scored: DataFrame, listings: DataFrame, page: int = 1, limit: int = 20,
                         **filters) -> DataFrame:
    """total, page, limit, pages = max(1, ceil(total/limit)) for the same filters."""
    filters.pop("sort_by", None)
    union = listing_union(scored, listings, **filters)
    return union.agg(F.count("*").alias("total")).select(
        "total", F.lit(page).alias("page"), F.lit(limit).alias("limit"),
        F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("total") / limit)).alias("pages"))


def product_listing_after(scored: DataFrame, listings: DataFrame, after: tuple, sort_by: str | None = None,
                          limit: int = 20, **filters) -> DataFrame:
    """The page of ``product_listing`` rows strictly after the row with key ``after``.

    ``after`` is (is_user_product, listing id, sort value, asin) of the last row seen.
    The order is the list's own, nulls last, so rows without a sort value and all
    listings are reached.  A deep page costs one filtered top-k instead of an offset scan.
    """
    user, lid, value, asin = after
    column, asc = SORT_OPTIONS.get(sort_by, (None, True))

    def past(c, v, up=True):
        if v is None:
            return F.lit(False)
        return F.coalesce((F.col(c) > v) if up else (F.col(c) < v), F.lit(False)) | F.col(c).isNull()

    def same(c, v):
        return F.col(c).isNull() if v is None else F.coalesce(F.col(c) == v, F.lit(False))
    tail = F.col("asin") > asin
    if column:
        tail = past(column, value, asc) | (same(column, value) & tail)
    src = 0 if user else 1
    cond = (F.col("_src") > src) | ((F.col("_src") == src) & (past("_lid", lid) | (same("_lid", lid) & tail)))
    union = listing_union(scored, listings, **filters)
    return union.where(cond).orderBy(*listing_order(sort_by)).limit(limit).drop("_src").withColumnRenamed("_lid", "listing_id")



# ---------------------------------------------------------------- T2..T5
def recommended(scored: DataFrame, limit: int = 10) -> DataFrame:
    """Top bestsellers by score; every product when there is no bestseller."""
    n_bs = scored.agg(F.count_if(F.col("isBestSeller")).alias("_n_bs"))
    return (with_row(scored, n_bs)
                  .where(F.col("isBestSeller") | (F.col("_n_bs") == 0))
                  .orderBy(F.col("demand_score").desc(), F.col("asin").asc()).limit(limit)
                  .select("asin", "title", CAT, "price", "stars", "boughtInLastMonth", "isBestSeller",
                          "demand_score"))


def predictions(scored: DataFrame, limit: int = 50, category: str | None = None,
                level: str | None = None) -> DataFrame:
    """Top N by score (optional category), then the level filter AFTER the limit."""
    base = scored if not category else scored.where(F.col(CAT) == category)
    top = base.orderBy(F.col("demand_score").desc(), F.col("asin").asc()).limit(limit)
    out = top.select("asin", "title", F.col(CAT).alias("category"), S.round_half("price", 2).alias("price"),
                     "stars", F.col("boughtInLastMonth").alias("bought_last_month"),
                     S.round_half("demand_score", 2).alias("demand_score"),
                     S.demand_level().alias("demand_level"),
                     S.confidence().alias("confidence"),
                     F.col("isBestSeller").alias("is_best_seller"))
    return out if not level else out.where(F.col("demand_level") == level)


def reorder_alerts(scored: DataFrame, limit: int = 30) -> DataFrame:
    """T4: low score and low sales, lowest score first."""
    return (scored.where(reorder_predicate())
                  .orderBy(F.col("demand_score").asc(), F.col("asin").asc()).limit(limit)
                  .select("asin", "title", F.col(CAT).alias("category"), S.round_half("price", 2).alias("price"),
                          "stars", F.col("boughtInLastMonth").alias("bought_last_month"),
                          S.round_half("demand_score", 2).alias("demand_score"),
                          F.lit("Low").alias("demand_level"), F.lit("Reorder Recommended").alias("alert")))


def top_movers(scored: DataFrame, limit: int = 30) -> DataFrame:
    """T5: most units sold."""
    return (scored.orderBy(F.col("boughtInLastMonth").desc(), F.col("asin").asc()).limit(limit)
                  .select("asin", "title", F.col(CAT).alias("category"), S.round_half("price", 2).alias("price"),
                          "stars", F.col("boughtInLastMonth").alias("bought_last_month"),
                          S.round_half("demand_score", 2).alias("demand_score"),
                          S.demand_level().alias("demand_level"),
                          F.col("isBestSeller").alias("is_best_seller")))


# ---------------------------------------------------------------- T6, T7
def category_top(scored: DataFrame, k: int = 10) -> DataFrame:
    """Top k by score within every category."""
    t = top_per_group(scored.where(F.col(CAT).isNotNull()), CAT,
                      [F.col("demand_score").desc(), F.col("asin").asc()], k)
    return t.select(F.col(CAT).alias("category"), "rank", "asin", "title", S.round_half("price", 2).alias("price"),
                    "stars", F.col("boughtInLastMonth").alias("bought_last_month"),
                    S.round_half("demand_score", 2).alias("demand_score"), S.demand_level().alias("demand_level"),
                    S.confidence(divisor=200.0).alias("confidence"), F.col("isBestSeller").alias("is_best_seller"))


def category_bottom(scored: DataFrame, k: int = 5) -> DataFrame:
    """Bottom k by score within every category (reorder candidates)."""
    t = top_per_group(scored.where(F.col(CAT).isNotNull()), CAT,
                      [F.col("demand_score").asc(), F.col("asin").asc()], k)
    return t.select(F.col(CAT).alias("category"), "rank", "asin", "title", S.round_half("price", 2).alias("price"),
                    "stars", F.col("boughtInLastMonth").alias("bought_last_month"),
                    S.round_half("demand_score", 2).alias("demand_score"), S.demand_level().alias("demand_level"))


def category_bought_top(scored: DataFrame, k: int = 10) -> DataFrame:
    """Top k by units within every category, short titles for charts."""
    t = top_per_group(scored.where(F.col(CAT).isNotNull()), CAT,
                      [F.col("boughtInLastMonth").desc(), F.col("asin").asc()], k)
    return t.select(F.col(CAT).alias("category"), "rank", F.substring("title", 1, 30).alias("title"),
                    F.col("boughtInLastMonth").alias("bought"), S.round_half("demand_score", 2).alias("score"))


# ---------------------------------------------------------------- T8..T11
def categories(scored: DataFrame) -> DataFrame:
    """Sorted distinct non-null categories with their count on every row."""
    d = scored.where(F.col(CAT).isNotNull()).select(CAT).distinct()
    n = d.agg(F.count("*").alias("count"))
    return with_row(d, n).orderBy(CAT).withColumnRenamed(CAT, "category")


def hero_rotation(scored: DataFrame, listings: DataFrame) -> DataFrame:
    """First 20 bestsellers of the list sorted by demand, listings dropped, keep 10."""
    union = listing_union(scored, listings, bestseller=True)
    first20 = union.orderBy(*listing_order("demand_desc")).limit(20)
    return (first20.where(~F.col("is_user_product"))
                   .orderBy(*listing_order("demand_desc")).limit(10).drop("_src", "_lid"))


def search_suggest(scored: DataFrame, listings: DataFrame, q: str, n: int = 6) -> DataFrame:
    """First 6 list rows for a query of at least 2 characters."""
    if q is None or len(q) < 2:
        return scored.limit(0).select("asin", "title", CAT, "price")
    return product_listing(scored, listings, page=1, limit=n, search=q).select("asin", "title", CAT, "price")


def trends_resort(trend_rows: DataFrame, by: str = "total_bought", n: int = 10) -> DataFrame:
    """Trend rows re-sorted by units or count (stable), first n for the chart."""
    if by not in ("total_bought", "product_count"):
        by = "avg_demand_score"
    first = F.col("rank").asc() if by != "avg_demand_score" else None
    order = [F.col("rank").asc()] if first is None else [F.col(by).desc(), first]
    return trend_rows.orderBy(*order).limit(n).drop("rank")

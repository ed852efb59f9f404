"""Seller listings: parsing, validation, unions with the catalog, lookups,
carts and anti joins (S4, P17, P18, J1-J7, T12-T14, U1).

Listings arrive as strings.  ``try_cast`` replaces the reference's
``try: float(...) except: continue``: a present but unparsable field drops the
row, a missing field takes its default.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalytics.functions.scalars import with_row
from catalytics.functions import scores as S
from catalytics.functions.predicates import parse_bool, reject_reason
from catalytics.operators.catalog import catalog_stats, normalize, with_stats
from catalytics.operators.ranking import range_row_number

CAT = "categoryName"
LISTING_COLUMNS = ["asin", "id", "owner_email", "title", CAT, "price", "stars", "boughtInLastMonth",
                   "isBestSeller", "description", "image_filename", "added_on"]


def _num(c: str, typ: str, default) -> tuple[Column, Column]:
    """(value, ok): missing -> default; present but unparsable -> not ok."""
    raw = F.col(c)
    v = raw.try_cast(typ)
    return (F.when(raw.isNull(), F.lit(default).cast(typ)).otherwise(v),
            raw.isNull() | v.isNotNull())


def parse_listings(raw: DataFrame) -> DataFrame:
    """Typed listings with a ``_valid`` flag and the raw numeric strings."""
    price, ok_p = _num("price", "double", 0.0)
    stars, ok_s = _num("stars", "double", 0.0)
    bought, ok_b = _num("boughtInLastMonth", "bigint", 0)
    asin = F.when(F.coalesce(F.col("asin"), F.lit("")) == "", F.lit(0).cast("bigint")) \
            .otherwise(F.col("asin").try_cast("bigint"))
    ok_a = asin.isNotNull()
    return raw.select(
        asin.alias("asin"),
        F.col("id").try_cast("bigint").alias("id"),
        F.lower(F.col("owner_email")).alias("owner_email"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(CAT, F.lit("")).alias(CAT),
        price.alias("price"), stars.alias("stars"), bought.alias("boughtInLastMonth"),
        parse_bool(F.coalesce("isBestSeller", F.lit("FALSE"))).alias("isBestSeller"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("image_filename", F.lit("")).alias("image_filename"),
        F.coalesce("added_on", F.lit("")).alias("added_on"),
        F.col("price").alias("price_raw"), F.col("stars").alias("stars_raw"),
        F.col("boughtInLastMonth").alias("bought_raw"),
        (ok_p & ok_s & ok_b & ok_a).alias("_valid"))


def listing_view(listings: DataFrame) -> DataFrame:
    """Rows that parse (P18); accepts raw strings or already-parsed rows."""
    p = listings if "_valid" in listings.columns else parse_listings(listings)
    return p.where(F.col("_valid"))


def scan_seller_listings(raw: DataFrame) -> DataFrame:
    """Migration read: skip rows without id, parse types and TRUE/FALSE."""
    p = parse_listings(raw.where(F.col("id").isNotNull() & (F.trim(F.col("id")) != "")))
    return p.where(F.col("_valid") & F.col("id").isNotNull()).select(*LISTING_COLUMNS)


def validate_listings(listings: DataFrame) -> DataFrame:
    """Every parsed listing with its first failed rule (null = valid)."""
    p = listing_view(listings)
    return p.select("asin", "id", "owner_email", "price", "stars", "boughtInLastMonth",
                    reject_reason().alias("reject_reason"))


def split_valid(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = validate_listings(listings)
    return v.where(F.col("reject_reason").isNull()), v.where(F.col("reject_reason").isNotNull())


# ---------------------------------------------------------------- J1, J2
def catalog_union_listings(scored: DataFrame, listings: DataFrame) -> DataFrame:
    """Listings first, then catalog, flagged by ``is_user_product``."""
    from catalytics.operators.ranking import listing_union
    return listing_union(scored, listings).withColumnRenamed("_src", "source_rank") \
                                          .withColumnRenamed("_lid", "listing_id")


# The columns of the stored training set.
TRAINING_COLUMNS = ["asin", "title", CAT, "price", "stars", "boughtInLastMonth", "isBestSeller",
                    "demand_score", "demand_level", "stars_norm", "bought_norm", "bs_norm", "price_norm",
                    "is_user_product"]


def training_union(catalog: DataFrame, listings: DataFrame) -> DataFrame:
    """Builder view: catalog + listings normalized with the catalog's stats
    (unrounded, listings unclipped), common columns, bought nulls -> 0."""
    stats = catalog_stats(catalog)
    base = ["asin", "title", CAT, "price", "stars", "boughtInLastMonth", "isBestSeller"]
    cat = normalize(catalog.select(*base), stats, round_norms=False).withColumn("is_user_product", F.lit(False))
    lst = listing_view(listings).where(F.col("asin").isNotNull()).select(*base) \
                                .fillna(0, subset=["boughtInLastMonth"])
    lst = normalize(lst, stats, round_norms=False).withColumn("is_user_product", F.lit(True))
    return cat.select(*TRAINING_COLUMNS).unionByName(lst.select(*TRAINING_COLUMNS))


# ---------------------------------------------------------------- J3, J4
def _first_listing_per_asin(listings: DataFrame, keys: DataFrame) -> DataFrame:
    """One listing per wanted asin (lowest id): the keys are semi-joined first, and the aggregate combines map-side."""
    v = listing_view(listings).join(keys, "asin", "left_semi")
    cols = [c for c in v.columns if c not in ("asin", "_valid")]
    return (v.groupBy("asin").agg(F.min_by(F.struct(*cols), F.col("id")).alias("l"))
             .select("asin", "l.*"))


def product_lookup(scored: DataFrame, listings: DataFrame, keys: DataFrame) -> DataFrame:
    """Batch point lookup; a listing wins over a catalog row; unknown keys drop."""
    k = keys.select("asin").distinct()
    lst = _first_listing_per_asin(listings, k).select(
        "asin", "title", CAT, "price", "stars", "boughtInLastMonth", "isBestSeller",
        S.quick_score().alias("demand_score"))
    cat = scored.join(k, "asin", "left_semi").select("asin", "title", CAT, "price", "stars", "boughtInLastMonth", "isBestSeller",
                                                     "demand_score")
    j = (k.join(lst.select("asin", F.struct(*[c for c in lst.columns if c != "asin"]).alias("l")), "asin", "left")
          .join(cat.select("asin", F.struct(*[c for c in cat.columns if c != "asin"]).alias("c")), "asin", "left")
          .where(F.col("l").isNotNull() | F.col("c").isNotNull()))
    fields = ["title", CAT, "price", "stars", "boughtInLastMonth", "isBestSeller", "demand_score"]
    return j.select("asin", *[F.when(F.col("l").isNotNull(), F.col(f"l.{f}")).otherwise(F.col(f"c.{f}")).alias(f)
                              for f in fields],
                    F.col("l").isNotNull().alias("is_user_product"))


def demand_lookup(scored: DataFrame, catalog: DataFrame, listings: DataFrame, keys: DataFrame) -> DataFrame:
    """Demand view per key; listings scored against catalog stats, clipped."""
    k = keys.select("asin").distinct()
    stats = catalog_stats(catalog)
    lst = with_stats(_first_listing_per_asin(listings, k), stats).select(
        "asin", "title", "stars", "boughtInLastMonth",
        S.clipped_score("stars", "boughtInLastMonth", "isBestSeller", "price").alias("demand_score"))
    lst = lst.select("asin", "title", "demand_score", S.demand_level().alias("demand_level"),
                     S.confidence(floor_zero=True).alias("confidence_score"), "stars",
                     F.col("boughtInLastMonth").alias("bought_last_month"), F.lit(True).alias("is_user_product"))
    cat = scored.join(k, "asin", "left_semi").select("asin", "title", S.round_half("demand_score", 2).alias("demand_score"),
                        S.demand_level().alias("demand_level"), S.confidence().alias("confidence_score"),
                        "stars", F.col("boughtInLastMonth").alias("bought_last_month"),
                        F.lit(False).alias("is_user_product"))
    from_lst = k.join(lst, "asin", "inner")
    from_cat = k.join(lst.select("asin"), "asin", "left_anti").join(cat, "asin", "inner")
    return from_lst.unionByName(from_cat)


# ---------------------------------------------------------------- J5, J6, J7
def _cart_items(carts: DataFrame) -> DataFrame:
    return carts.select("user_email", F.explode("cart").alias("asin"))


def cart_resolve(scored: DataFrame, listings: DataFrame, carts: DataFrame) -> DataFrame:
    """Per user: resolved items and their subtotal (unknown asins dropped)."""
    items = _cart_items(carts)
    found = product_lookup(scored, listings, items.select("asin"))
    return (items.join(found.select("asin", "price"), "asin", "inner")
                 .groupBy("user_email")
                 .agg(F.count("*").alias("items"),
                      F.round(S.exact_total("price"), 2)
                      .cast("double").alias("subtotal")))


def cart_orphans(scored: DataFrame, listings: DataFrame, carts: DataFrame) -> DataFrame:
    """Cart entries that resolve to no product."""
    items = _cart_items(carts)
    found = product_lookup(scored, listings, items.select("asin"))
    return items.join(found.select("asin"), "asin", "left_anti").select("user_email", "asin")


def asset_asins(manifest: DataFrame, path_col: str = "path") -> DataFrame:
    """asin from an image file name ``{asin}.jpg``."""
    return manifest.select(F.regexp_extract(F.col(path_col), r"([^/]+)\.jpg$", 1)
                           .try_cast("bigint").alias("asin")).where(F.col("asin").isNotNull())


def missing_assets(scored: DataFrame, manifest: DataFrame) -> DataFrame:
    """Products without an image file (left anti join)."""
    return scored.select("asin", "title", CAT).join(asset_asins(manifest), "asin", "left_anti")


# ---------------------------------------------------------------- T12..T14, U1
def next_ids(catalog: DataFrame, listings: DataFrame) -> DataFrame:
    """Next asin = max over both tables + 1; next id = max id + 1 (1 if none)."""
    v = listing_view(listings)
    a = catalog.agg(F.max("asin").alias("m1"))
    b = v.agg(F.max("asin").alias("m2"), F.max("id").alias("mid"))
    return with_row(a, b).select(
        (F.greatest(F.coalesce("m1", F.lit(0).cast("bigint")), F.coalesce("m2", F.lit(0).cast("bigint"))) + 1)
        .alias("next_asin"),
        (F.coalesce("mid", F.lit(0).cast("bigint")) + 1).alias("next_id"))


def listing_inserts(catalog: DataFrame, listings: DataFrame, batch: DataFrame,
                    added_on: dt.datetime = dt.datetime(2026, 5, 1, 12, 0)) -> DataFrame:
    """Assign asin/id to the valid rows of a batch of new listings in arrival order (``seq``).

    The rank over the whole batch comes from ranges of equal numbers of rows, whatever the
    gaps in ``seq``, so no single task sees the whole batch.
    """
    ranked = range_row_number(batch.where(reject_reason().isNull()), ["seq"], out="rn")
    ids = next_ids(catalog, listings)
    return (with_row(ranked, ids)
                  .select((F.col("next_asin") + F.col("rn") - 1).alias("asin"),
                          (F.col("next_id") + F.col("rn") - 1).alias("id"),
                          F.lower("owner_email").alias("owner_email"), "title", CAT, "price", "stars",
                          "boughtInLastMonth", "isBestSeller", "description",
                          F.lit("").alias("image_filename"),
                          F.lit(added_on.strftime("%Y-%m-%d %H:%M")).alias("added_on")))


def user_orders(orders: DataFrame, email: str) -> DataFrame:
    """One user's orders, newest first, with the count on each row."""
    mine = orders.where(F.col("user_email") == email.lower())
    n = F.count("*").over(Window.partitionBy("user_email"))            # one user's orders
    return (mine.select("order_id", "created_at", F.size("items").alias("items"), S.round_half("total", 2).alias("total"),
                        "status", n.alias("count"))
                .orderBy(F.col("created_at").desc(), F.col("order_id").desc()))


def user_listings(listings: DataFrame, email: str) -> DataFrame:
    """Listings of one owner, email compared case-insensitively."""
    return listing_view(listings).where(F.lower(F.col("owner_email")) == email.lower()).select(*LISTING_COLUMNS)

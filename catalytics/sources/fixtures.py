"""Business tables derived from the driver's TPC-H-like tables.

The mapping is documented in FIXTURES.md (F1-F8).  Each function is a lazy
DataFrame over the driver Parquet files, so its work grows with the data.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalytics.functions.scalars import with_row
from catalytics.functions.scores import BESTSELLER_STARS
from catalytics.sources.tables import read_table

# Fixed fixture parameters (FIXTURES.md).
SALES_WINDOW_DAYS = 365          # boughtInLastMonth = units in the window before the last ship date
LISTING_PRICE_FACTOR = 1.25
ASSET_SKIP_EVERY = 7             # parts with p_partkey % 7 = 0 have no image
ORPHAN_EVERY = 10                # users with key % 10 = 0 get one unknown asin in the cart
EXPRESS_PRIORITY = "1-URGENT"
EXPRESS_SHIPPING = 50.0
PAYMENT_METHODS = ("card", "upi", "cod")


def stars_expr(size="p_size", key="p_partkey"):
    """Deterministic rating 1.0-5.0 from part columns (the tables hold none)."""
    return F.round(1.0 + ((F.col(size) * 7 + F.col(key) * 13) % 41) / 10.0, 1)


def units_by_part(spark: SparkSession, sf_dir: str, window_days: int = SALES_WINDOW_DAYS,
                  as_of: dt.datetime | None = None) -> DataFrame:
    """Units per part shipped in (as_of - window, as_of]; partial aggregation map-side.

    Without ``as_of`` the window ends at the last ship date, a scalar subquery that
    Spark runs with the query: building the plan reads no rows.
    """
    li = read_table(spark, sf_dir, "lineitem")
    days = F.make_dt_interval(F.lit(window_days))
    if as_of is None:                                     # no row lies after the last ship date
        recent = F.col("l_shipdate") > li.agg((F.max("l_shipdate") - days).alias("start")).scalar()
    else:
        end = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(li.schema["l_shipdate"].dataType.simpleString())
        recent = (F.col("l_shipdate") > end - days) & (F.col("l_shipdate") <= end)
    return li.where(recent).groupBy("l_partkey").agg(F.sum("l_quantity").alias("units"))


def catalog_base(spark: SparkSession, sf_dir: str, window_days: int = SALES_WINDOW_DAYS,
                 as_of: dt.datetime | None = None) -> DataFrame:
    """the product catalog (asin, title, categoryName, price, stars,
    boughtInLastMonth, isBestSeller)."""
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    sold = units_by_part(spark, sf_dir, window_days, as_of)
    return (part.join(sold, part.p_partkey == sold.l_partkey, "left")
                .select(F.col("p_partkey").alias("asin"),
                        F.col("p_name").alias("title"),
                        F.col("p_brand").alias("categoryName"),
                        F.col("p_retailprice").alias("price"),
                        stars_expr().alias("stars"),
                        F.coalesce(F.col("units"), F.lit(0.0)).cast("bigint").alias("boughtInLastMonth"))
                .withColumn("isBestSeller", F.col("stars") > BESTSELLER_STARS))


def _supplier_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    n = sup.agg(F.count("*").alias("n_supp"))          # one row
    return sup, n


def _listing_rows(spark: SparkSession, sf_dir: str, units: DataFrame | None = None) -> DataFrame:
    """Every part as a seller listing.

    ``units`` (l_partkey, units) defaults to the F1 sales window; pass the
    catalog's column to avoid a second pass over lineitem."""
    part = (read_table(spark, sf_dir, "part")
            .select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))
    sup, n = _supplier_owner(spark, sf_dir)
    pmax = read_table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("max_key"))
    sold = units if units is not None else units_by_part(spark, sf_dir)
    owned = (with_row(with_row(part, n), pmax)
                 .withColumn("owner_key", F.col("p_partkey") % F.col("n_supp")))
    return (owned.join(sup, owned.owner_key == sup.s_suppkey, "left")
                 .join(sold, owned.p_partkey == sold.l_partkey, "left")
                 .select(
                     "p_partkey",
                     (F.col("p_partkey") + 1 + F.col("max_key")).alias("asin_num"),
                     F.col("p_partkey").cast("bigint").alias("id_num"),
                     F.lower(F.col("s_name")).alias("owner_email"),
                     F.col("p_name").alias("title"),
                     F.col("p_brand").alias("categoryName"),
                     (F.col("p_retailprice") * LISTING_PRICE_FACTOR).alias("price_num"),
                     stars_expr().alias("stars_num"),
                     F.coalesce(F.col("units"), F.lit(0.0)).cast("bigint").alias("bought_num"),
                     F.col("p_type").alias("description")))


def listings_raw(spark: SparkSession, sf_dir: str, catalog: DataFrame | None = None) -> DataFrame:
    """seller listings as the all-string rows of the seller CSV.

    With ``catalog`` given, units come from its boughtInLastMonth column."""
    units = None if catalog is None else catalog.select(F.col("asin").alias("l_partkey"),
                                                        F.col("boughtInLastMonth").alias("units"))
    rows = _listing_rows(spark, sf_dir, units)
    return rows.select(
        F.col("asin_num").cast("string").alias("asin"),
        (F.col("id_num") + 1).cast("string").alias("id"),
        "owner_email", "title", "categoryName",
        F.col("price_num").cast("string").alias("price"),
        F.col("stars_num").cast("string").alias("stars"),
        F.col("bought_num").cast("string").alias("boughtInLastMonth"),
        F.when(F.col("stars_num") > BESTSELLER_STARS, F.lit("TRUE")).otherwise(F.lit("FALSE")).alias("isBestSeller"),
        "description",
        F.when(F.col("p_partkey") % 3 == 0,
               F.format_string("up_%s_%d.png", F.split(F.col("owner_email"), "#").getItem(1),
                               F.col("id_num") + 1)).otherwise(F.lit("")).alias("image_filename"),
        F.date_format(F.lit("2026-04-25 09:00:00").cast("timestamp") + F.make_interval(mins=F.col("id_num").cast("int")),
                      "yyyy-MM-dd HH:mm").alias("added_on"))


def insert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New listings to insert (no asin/id yet), one per part.

    ``seq`` is the arrival order; owner emails keep their original case.
    """
    rows = _listing_rows(spark, sf_dir)
    return rows.select(
        F.col("p_partkey").alias("seq"),
        F.when(F.col("p_partkey") % 40 == 10, F.upper(F.col("owner_email")))
         .otherwise(F.col("owner_email")).alias("owner_email"),
        "title", "categoryName",
        F.col("price_num").alias("price"), F.col("stars_num").alias("stars"),
        F.col("bought_num").alias("boughtInLastMonth"),
        (F.col("stars_num") > BESTSELLER_STARS).alias("isBestSeller"),
        "description")


def _users_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey, "left")
                .select("c_custkey",
                        F.lower(F.col("c_name")).alias("email"),
                        F.sha2(F.col("c_custkey").cast("string"), 256).alias("password_hash"),
                        F.col("c_name").alias("name"),
                        F.format_string("+91 %05d %05d", (F.col("c_custkey") * 7919) % 100000,
                                        F.col("c_custkey") % 100000).alias("phone"),
                        F.col("c_mktsegment").alias("department"),
                        F.col("n_name").alias("city"),
                        F.when(F.col("c_custkey") % 50 == 0, F.lit("Admin")).otherwise(F.lit("Analyst")).alias("role"),
                        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int")),
                                      "yyyy-MM-dd").alias("joined")))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: user profiles from customer + nation (email = lower(c_name))."""
    return _users_keyed(spark, sf_dir).drop("c_custkey")


def users_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as they arrive from the user CSV: untrimmed mixed-case emails,
    some blank, some without a role."""
    u = _users_keyed(spark, sf_dir)
    key = F.col("c_custkey")
    return u.select(
        F.when(key % 17 == 0, F.lit("  "))
         .when(key % 3 == 0, F.concat(F.lit(" "), F.upper(F.col("email")), F.lit(" ")))
         .otherwise(F.col("email")).alias("email"),
        "password_hash", "name", "phone", "department", "city",
        F.when(key % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("role")).alias("role"),
        "joined")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    return li


def order_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 amounts only: order_id, items (count), subtotal, shipping, total, delivery_speed.

    Grouped by (order, part) and then by order: two hash aggregates, no item array,
    and neither customer nor nation is read.
    """
    cents = F.sum(F.round(F.col("l_extendedprice") * 100.0).cast("bigint")).alias("cents")
    per_part = order_lines(spark, sf_dir).groupBy("l_orderkey", "l_partkey").agg(cents)
    per_order = per_part.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("items"), F.sum("cents").alias("subtotal_cents"))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    express = F.col("o_orderpriority") == EXPRESS_PRIORITY
    shipping = F.when(express, F.lit(EXPRESS_SHIPPING)).otherwise(F.lit(0.0))
    return o.join(per_order, o.o_orderkey == per_order.l_orderkey).select(
        F.col("o_orderkey").alias("order_id"), "items", (F.col("subtotal_cents") / 100.0).alias("subtotal"), shipping.alias("shipping"),
        ((F.col("subtotal_cents") + (shipping * 100.0).cast("bigint")) / 100.0).alias("total"),
        F.when(express, F.lit("express")).otherwise(F.lit("standard")).alias("delivery_speed"))


def orders(spark: SparkSession, sf_dir: str, user_email: str | None = None) -> DataFrame:
    """order documents (items array, nested address struct), of one user if given.

    A user's filter is applied to customers first; orders and then order lines are
    semi-joined with what is left before anything is grouped.
    """
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    lines = order_lines(spark, sf_dir)
    if user_email is not None:
        who = read_table(spark, sf_dir, "customer").where(F.lower("c_name") == user_email.lower()).select("c_custkey")
        o = o.join(who, o.o_custkey == who.c_custkey, "left_semi")
        lines = lines.join(o.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    per_order = (lines
                 .groupBy("l_orderkey")
                 .agg(F.array_sort(F.collect_set("l_partkey")).alias("items"),
                      F.sum(F.round(F.col("l_extendedprice") * 100.0).cast("bigint")).alias("subtotal_cents")))
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    express = F.col("o_orderpriority") == EXPRESS_PRIORITY
    shipping = F.when(express, F.lit(EXPRESS_SHIPPING)).otherwise(F.lit(0.0))
    return (o.join(per_order, o.o_orderkey == per_order.l_orderkey, "inner")
             .join(cust, o.o_custkey == cust.c_custkey, "left")
             .join(F.broadcast(nation), F.col("c_nationkey") == nation.n_nationkey, "left")
             .select(F.col("o_orderkey").alias("order_id"),
                     F.lower(F.col("c_name")).alias("user_email"),
                     "items",
                     (F.col("subtotal_cents") / 100.0).alias("subtotal"),
                     shipping.alias("shipping"),
                     ((F.col("subtotal_cents") + (shipping * 100.0).cast("bigint")) / 100.0).alias("total"),
                     F.element_at(F.array(*[F.lit(m) for m in PAYMENT_METHODS]),
                                  (F.col("o_orderkey") % len(PAYMENT_METHODS) + 1).cast("int")).alias("payment_method"),
                     F.when(express, F.lit("express")).otherwise(F.lit("standard")).alias("delivery_speed"),
                     F.struct(F.col("c_name").alias("name"),
                              F.format_string("%d Market Road", F.col("o_custkey")).alias("address"),
                              F.col("n_name").alias("city"),
                              F.format_string("%06d", (F.col("o_custkey") * 37) % 1000000).alias("pin"),
                              F.format_string("+91 %010d", F.col("o_custkey")).alias("phone")).alias("address"),
                     F.lit("confirmed").alias("status"),
                     F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at")))


def stored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders that are stored (F3): those with a line.  Only keys are read, and lines are met by a semi join."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(lines, o.o_orderkey == lines.l_orderkey, "left_semi")


def carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per user, the distinct parts of the newest order (+1 unknown asin
    for users with key % 10 = 0).  Columns: user_email, cart (array<bigint>)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    newest = (o.groupBy("o_custkey")
               .agg(F.max(F.struct("o_orderdate", "o_orderkey")).getField("o_orderkey").alias("newest")))
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    items = (newest.join(li, newest.newest == li.l_orderkey, "inner")
                   .groupBy("o_custkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("cart")))
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    unknown = F.lit(-1) - F.col("o_custkey")
    return (items.join(cust, items.o_custkey == cust.c_custkey, "inner")
                 .select(F.lower(F.col("c_name")).alias("user_email"),
                         F.when(F.col("o_custkey") % ORPHAN_EVERY == 0,
                                F.concat(F.col("cart"), F.array(unknown.cast("bigint"))))
                          .otherwise(F.col("cart")).alias("cart")))


def asset_manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image files present, one per part with p_partkey % 7 <> 0."""
    part = read_table(spark, sf_dir, "part").select("p_partkey")
    return (part.where(F.col("p_partkey") % ASSET_SKIP_EVERY != 0)
                .select(F.format_string("images/%d.jpg", F.col("p_partkey")).alias("path")))


def listing_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, owner_email) of the F2 listings, without their sales columns."""
    part = read_table(spark, sf_dir, "part").select("p_partkey")
    sup, n = _supplier_owner(spark, sf_dir)
    owned = with_row(part, n).withColumn("owner_key", F.col("p_partkey") % F.col("n_supp"))
    return owned.join(sup, owned.owner_key == sup.s_suppkey, "left").select(
        (F.col("p_partkey").cast("bigint") + 1).alias("lid"),
        F.lower(F.col("s_name")).alias("owner_email"))


def change_log(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """F6 base for one event type: events with the listing they touch (id)
    and the acting owner.

    click -> listing update (price = value), error -> delete, view -> image
    upload (odd user).  Every fifth acting user is not the owner, so the
    change must not apply; even users write the owner's email upper-cased.
    """
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type") == event_type)
    lst = listing_owners(spark, sf_dir)
    n_lst = lst.agg(F.count("*").alias("n_listings"))
    e = with_row(ev, n_lst).withColumn("listing_id", F.col("event_id") % F.col("n_listings") + 1)
    return (e.join(lst, e.listing_id == lst.lid, "left")
             .select("event_id", "ts", "user_id", "event_type", "value", "props", "listing_id",
                     F.when(F.col("user_id") % 5 == 0, F.lit("intruder@example.com"))
                      .when(F.col("user_id") % 2 == 0, F.upper(F.col("owner_email")))
                      .otherwise(F.col("owner_email")).alias("actor_email")))


def listing_updates_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update requests: (id, owner_email, ts) + nullable editable fields."""
    c = change_log(spark, sf_dir, "click")
    return c.select(F.col("listing_id").alias("id"), F.col("actor_email").alias("owner_email"), "ts",
                    F.lit(None).cast("string").alias("title"),
                    F.lit(None).cast("string").alias("categoryName"),
                    F.col("value").alias("price"),
                    F.when(F.col("event_id") % 4 == 0, F.round(1.0 + (F.col("event_id") % 41) / 10.0, 1)
                           ).alias("stars"),
                    F.lit(None).cast("bigint").alias("boughtInLastMonth"),
                    F.lit(None).cast("boolean").alias("isBestSeller"),
                    F.when(F.col("event_id") % 3 == 0, F.get_json_object("props", "$.k")
                           ).alias("description"))


def listing_deletes_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = change_log(spark, sf_dir, "error")
    return c.select(F.col("listing_id").alias("id"), F.col("actor_email").alias("owner_email"), "ts")


def registrations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups; emails repeat (same user signs up again) and vary in case."""
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    cust = read_table(spark, sf_dir, "customer").agg(F.count("*").alias("n_cust"))
    e = with_row(ev, cust)
    email = F.when(F.col("user_id") % 3 == 0,
                   F.format_string("Customer#%09d", F.col("user_id") % F.col("n_cust")))\
             .otherwise(F.format_string("New.User%d@Example.com", F.col("user_id")))
    return e.select("event_id", "ts", email.alias("email"),
                    F.format_string("User %d", F.col("user_id")).alias("name"))


def profile_updates_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile edits: empty strings mean 'not supplied'."""
    ev = read_table(spark, sf_dir, "events").where(
        (F.col("event_type") == "view") & (F.col("user_id") % 2 == 0))
    cust = read_table(spark, sf_dir, "customer").agg(F.count("*").alias("n_cust"))
    e = with_row(ev, cust)
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.format_string("customer#%09d", F.col("user_id") % F.col("n_cust")).alias("email"), "ts",
                    F.lit("").alias("name"),
                    F.when(k % 2 == 0, F.format_string("+91 %05d", k)).otherwise(F.lit("")).alias("phone"),
                    F.lit("").alias("department"),
                    F.format_string("City-%d", k).alias("city"),
                    F.when(k % 7 == 0, F.lit("Manager")).otherwise(F.lit("")).alias("role"),
                    F.when(k % 11 == 0, F.format_string("secret-%d", k)).otherwise(F.lit("")).alias("new_password"))


def image_uploads_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = change_log(spark, sf_dir, "view").where(F.col("user_id") % 2 == 1)
    return c.select(F.col("listing_id").alias("id"), F.col("actor_email").alias("owner_email"), "ts",
                    F.format_string("up_%d_%d.png", F.col("user_id"), F.col("event_id")).alias("image_filename"))


def purchases_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as order lines: order_id, asin = event_id % count(part),
    units, ts, user_email, amount."""
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    n_part = read_table(spark, sf_dir, "part").agg(F.count("*").alias("n_parts"))
    return with_row(ev, n_part).select(
        F.col("event_id").alias("order_id"), (F.col("event_id") % F.col("n_parts")).alias("asin"),
        (F.col("user_id") % 3 + 1).cast("bigint").alias("units"), "ts",
        F.format_string("Customer#%09d", F.col("user_id")).alias("user_email"),
        F.col("value").alias("amount"))


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order requests as they are posted: the F3 orders with their time, some posted again later.

    Every seventh order (key % 7 = 3) is posted a second time a day later, with an upper-case
    email, another payment method and express delivery: the first request is the order.
    """
    first = orders(spark, sf_dir).select(
        "order_id", F.to_timestamp("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "user_email", "items", "subtotal", "shipping",
        "total", "payment_method", "delivery_speed", "address")
    # the orders are put together once: each gives one row or two
    times = F.when(F.col("order_id") % 7 == 3, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    again = {"ts": F.col("ts") + F.make_dt_interval(F.lit(1)), "user_email": F.upper("user_email"), "payment_method": F.lit("repeat"),
             "delivery_speed": F.lit("express")}
    return first.withColumn("_again", F.explode(times)).withColumns(
        {c: F.when(F.col("_again"), x).otherwise(F.col(c)) for c, x in again.items()}).drop("_again")


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image contents (asin, version, body) of the bestsellers: version 0, and for every third product one or two uploads that replace it."""
    part = read_table(spark, sf_dir, "part").where(stars_expr() > BESTSELLER_STARS).select(F.col("p_partkey").alias("asin"), "p_name")
    last = F.when(F.col("asin") % 3 == 0, F.col("asin") % 2 + 1).otherwise(F.lit(0))
    each = part.withColumn("version", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    return each.select("asin", "version", F.concat_ws(" ", F.lit("image"), F.col("asin").cast("string"), "p_name", F.lit("v") , F.col("version").cast("string")).alias("body"))


def upload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload requests (id, owner_email, ts, filename) with accepted, upper-case, wrong and missing extensions."""
    c = change_log(spark, sf_dir, "view")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".jpg", ".PNG", ".webp", ".gif", ".jpeg", "", ".jpg.exe")]), (F.col("event_id") % 7 + 1).cast("int"))
    return c.select(F.col("listing_id").alias("id"), F.concat(F.col("actor_email"), F.lit("@shop.example")).alias("owner_email"), "ts",
                    F.concat(F.lit("photo "), F.col("event_id").cast("string"), ext).alias("filename"))


def sold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the category of their product, the month and the price: categoryName, month (yyyy-MM), price."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    part = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("categoryName"))
    return lines.join(part, lines.l_partkey == part.p_partkey).select("categoryName", F.date_format("l_shipdate", "yyyy-MM").alias("month"),
                                                                       F.col("l_extendedprice").alias("price"))

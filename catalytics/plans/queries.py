"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Parameters are the reference's defaults (top=20, limit=50, ...).  Every query
reads the driver tables (or tables Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalytics.operators import aggregates as A
from catalytics.operators import listings as L
from catalytics.operators import ranking as R
from catalytics.operators.catalog import catalog_stats, normalize, score_catalog
from catalytics.sources import fixtures as X
from catalytics.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

# Fixed query parameters (the reference's defaults, and fixture picks).
SEARCH_WORD = "red"             # a word present in generated part names
SEARCH_PATTERN = "r.d"          # found by the catalog's regular expression, not in the listings' plain text
LISTING_OWNER = "Supplier#000000001"   # mixed case on purpose
ORDER_USER = "Customer#000000001"
AFTER_PRICE = 990.0             # the keyset page starts below this price


def catalog(spark, d):
    return X.catalog_base(spark, d)


def scored(spark, d):
    return score_catalog(X.catalog_base(spark, d))


def listings(spark, d):
    return X.listings_raw(spark, d)


def owned(spark, d, owner=None):
    """One seller's listings: few, so that pages reach the catalog rows."""
    return listings(spark, d).where(F.lower("owner_email") == (owner or LISTING_OWNER).lower())


def cart_keys(spark, d):
    """The products in all carts, once each."""
    return X.carts(spark, d).select(F.explode("cart").alias("asin")).distinct()


def sorted_page(sort_by):
    return lambda s, d: R.product_listing(scored(s, d), owned(s, d), page=2, limit=20, sort_by=sort_by, min_stars=3.0)


def page_after(spark, d):
    """The catalog rows that follow a given place of the list by falling price, found by key instead of by offset."""
    return R.product_listing_after(scored(spark, d), owned(spark, d), (False, None, AFTER_PRICE, 0), sort_by="price_desc", limit=20,
                                   min_stars=3.0).drop("listing_id")


def _features(spark, d):
    c = X.catalog_base(spark, d)
    return normalize(c, catalog_stats(c), round_norms=True, level=False)


QUERIES: dict[str, Query] = {
    # ---- sources / scalar features
    "scan_catalog": lambda s, d: scan_catalog_csv(s, d),
    "demand_features": lambda s, d: _features(s, d).select("asin", "stars_norm", "bought_norm", "bs_norm", "price_norm"),
    "demand_score": lambda s, d: _features(s, d).select("asin", "demand_score"),
    "demand_level": lambda s, d: scored(s, d).select("asin", "demand_score", "demand_level"),
    # ---- aggregates
    "stats": lambda s, d: A.stats(scored(s, d)),
    "summary": lambda s, d: A.summary(scored(s, d)),
    "trends": lambda s, d: A.trends(scored(s, d), 20),
    "trend_cards": lambda s, d: A.trend_cards(A.trends(scored(s, d), 20)),
    "trend_recommendation": lambda s, d: A.trend_recommendation(A.trends(scored(s, d), 20, ranked=True)),
    "category_distribution": lambda s, d: A.category_distribution(scored(s, d), 12),
    "category_distribution_summary": lambda s, d: A.category_distribution_summary(scored(s, d), 12),
    "price_distribution": lambda s, d: A.price_distribution(scored(s, d), 10),
    "price_keep_semijoin": lambda s, d: A.price_keep(scored(s, d), 10).select("asin", "categoryName", "price"),
    "demand_mix": lambda s, d: A.demand_mix(scored(s, d)),
    "demand_bubble": lambda s, d: A.demand_bubble(scored(s, d), 15),
    "correlation_matrix": lambda s, d: A.correlation_matrix(scored(s, d)).drop("i", "j"),
    "correlation_pairs": lambda s, d: A.correlation_pairs(scored(s, d)),
    "price_rating_corr": lambda s, d: A.price_rating_corr(scored(s, d)),
    "inventory_metrics": lambda s, d: A.inventory_metrics(scored(s, d), 30),
    "inventory_categories": lambda s, d: A.inventory_categories(scored(s, d), 15),
    "category_stats": lambda s, d: A.category_stats(scored(s, d)),
    "price_buckets": lambda s, d: A.price_buckets(scored(s, d)),
    "stars_histogram": lambda s, d: A.stars_histogram(scored(s, d)),
    "predictions_summary": lambda s, d: A.predictions_summary(R.predictions(scored(s, d), 50)),
    "monthly_units": lambda s, d: A.monthly_units(s, d),
    "monthly_insights": lambda s, d: A.monthly_insights(A.monthly_units(s, d)),
    "seasonal_allocation": lambda s, d: A.seasonal_allocation(scored(s, d)),
    "order_totals": lambda s, d: A.order_totals(X.order_amounts(s, d)),
    # ---- ranking
    "product_listing": lambda s, d: R.product_listing(scored(s, d), listings(s, d), page=2, limit=20,
                                                      sort_by="price_asc", min_stars=3.0),
    **{f"product_listing_{by}": sorted_page(by) for by in R.SORT_OPTIONS},
    "product_listing_after": page_after,
    "product_listing_meta": lambda s, d: R.product_listing_meta(scored(s, d), listings(s, d), page=2, limit=20,
                                                                min_stars=3.0),
    "recommended": lambda s, d: R.recommended(scored(s, d), 10),
    "predictions": lambda s, d: R.predictions(scored(s, d), 50),
    "predictions_level": lambda s, d: R.predictions(scored(s, d), 50, category=EQ_CATEGORY, level="Medium"),
    "reorder_alerts": lambda s, d: R.reorder_alerts(scored(s, d), 30),
    "top_movers": lambda s, d: R.top_movers(scored(s, d), 30),
    "category_top": lambda s, d: R.category_top(scored(s, d), 10),
    "category_bottom": lambda s, d: R.category_bottom(scored(s, d), 5),
    "category_bought_top": lambda s, d: R.category_bought_top(scored(s, d), 10),
    "categories": lambda s, d: R.categories(scored(s, d)),
    "hero_rotation": lambda s, d: R.hero_rotation(scored(s, d), owned(s, d, "Supplier#000000002")),
    "hero_rotation_seller": lambda s, d: R.hero_rotation(scored(s, d), owned(s, d)),
    "search_suggest": lambda s, d: R.search_suggest(scored(s, d), listings(s, d), SEARCH_WORD),
    "search_suggest_seller": lambda s, d: R.search_suggest(scored(s, d), owned(s, d), SEARCH_PATTERN),
    "trends_resort": lambda s, d: R.trends_resort(A.trends(scored(s, d), 20, ranked=True), "total_bought"),
    "next_ids": lambda s, d: L.next_ids(catalog(s, d), listings(s, d)),
    "user_orders": lambda s, d: L.user_orders(X.orders(s, d, ORDER_USER), ORDER_USER),
    "user_listings": lambda s, d: L.user_listings(listings(s, d), LISTING_OWNER),
    # ---- listings, joins
    "scan_seller_listings": lambda s, d: L.scan_seller_listings(malformed(s, d, blank_ids=True)),
    "validate_listings": lambda s, d: L.validate_listings(invalid(s, d)),
    "listings_accepted": lambda s, d: L.split_valid(invalid(s, d))[0],
    "listings_rejected": lambda s, d: L.split_valid(invalid(s, d))[1],
    "catalog_union_listings": lambda s, d: L.catalog_union_listings(scored(s, d), listings(s, d)),
    "training_union": lambda s, d: L.training_union(catalog(s, d), listings(s, d)),
    "product_lookup": lambda s, d: L.product_lookup(scored(s, d), X.listings_raw(s, d, catalog(s, d)), cart_keys(s, d)),
    "demand_lookup": lambda s, d: L.demand_lookup(scored(s, d), catalog(s, d), X.listings_raw(s, d, catalog(s, d)), cart_keys(s, d)),
    "cart_resolve": lambda s, d: L.cart_resolve(scored(s, d), listings(s, d), X.carts(s, d)),
    "cart_orphans": lambda s, d: L.cart_orphans(scored(s, d), listings(s, d), X.carts(s, d)),
    "missing_assets": lambda s, d: L.missing_assets(scored(s, d), X.asset_manifest_rows(s, d)),
    "listing_inserts": lambda s, d: L.listing_inserts(catalog(s, d), listings(s, d), insert_requests(s, d)),
}


# ---------------------------------------------------------------- more sources, functions, ML, changes
from catalytics.functions import predicates as P  # noqa: E402
from catalytics.functions import scores as S  # noqa: E402
from catalytics.operators import changes as C  # noqa: E402
from catalytics.operators import ml as M  # noqa: E402
from catalytics.operators import sampling as SM  # noqa: E402
from catalytics.operators import sketches as SK  # noqa: E402
from catalytics.sources import images as IM  # noqa: E402
from catalytics.sources import quarantine as Q  # noqa: E402
from catalytics.sources import readers as RD  # noqa: E402
from catalytics.sources import stored as SD  # noqa: E402
from catalytics.streaming import orders as ST  # noqa: E402

REGEX_PATTERN = "^(red|blue) "
LITERAL_WORD = "GIZMO"
EQ_CATEGORY = "Brand#1"
DEEP_PAGE = 31
SKETCH_MONTHS = ("1994-02", "1996-07")   # the period whose quartiles come from monthly sketches
FEED_SINCE = "2024-01-15"       # first day of the streamed units that feed the catalog


def insert_requests(spark, d):
    """The insert batch with some invalid rows, and one that arrives far behind all others."""
    seq = F.col("seq")
    return X.insert_batch(spark, d).withColumns({
        "price": F.when(seq % 29 == 7, F.lit(0.0)).otherwise(F.col("price")), "title": F.when(seq % 31 == 9, F.lit(" ")).otherwise(F.col("title")),
        "seq": F.when(seq == 5, seq + 10 ** 12).otherwise(seq)})


def raw_feed(spark, d):
    """A raw product feed with the second set of source column names."""
    p = read_table(spark, d, "part")
    return p.select(F.col("p_name").alias("productDisplayName"), F.col("p_brand").alias("masterCategory"),
                    F.format_string("%d.jpg", F.col("p_partkey")).alias("image"))


def catalog_documents(spark, d):
    """The catalog as loosely typed documents (numbers stored as strings, an _id)."""
    c = catalog(spark, d)
    return c.select(F.md5(F.col("asin").cast("string")).alias("_id"), F.col("asin").cast("string").alias("asin"),
                    "title", "categoryName", F.col("price").cast("string").alias("price"),
                    F.col("stars").cast("string").alias("stars"),
                    F.col("boughtInLastMonth").cast("string").alias("boughtInLastMonth"), "isBestSeller")


def training(spark, d):
    return L.training_union(catalog(spark, d), listings(spark, d))


def balanced(spark, d):
    return SM.balance_classes(training(spark, d))


def split_frame(spark, d):
    return SM.model_frame(scored(spark, d))


def standardized(spark, d):
    z = SM.standardize(split_frame(spark, d))
    return z.select("asin", "split", *[S.round_half(f"z_{f}", 6).alias(f"z_{f}") for f in SM.FEATURES])


def write_training_csv(spark, d):
    """Write the balanced set as CSV into the shared folder, read it back typed."""
    from catalytics.session import scratch_path
    b = balanced(spark, d)
    path = scratch_path(spark, "training-csv")
    RD.write_table(b, path, fmt="csv")
    return spark.read.schema(b.schema).option("header", True).csv(path)


def purchases(spark, d):
    return X.purchases_log(spark, d)


def _stored(spark, df, name, fmt):
    """Write a table in the shared folder in the given format; its path."""
    from catalytics.session import scratch_path
    path = scratch_path(spark, name)
    RD.write_table(df, path, fmt=fmt)
    return path


def scan_catalog_csv(spark, d):
    """The catalog written as CSV with a header, read back by header name with its types."""
    return RD.read_catalog(spark, _stored(spark, catalog(spark, d), "catalog", "csv"))


def csv_to_json(spark, d):
    """The listing CSV read as strings, written as JSON lines, the lines read back."""
    raw = RD.read_listings_csv(spark, _stored(spark, listings(spark, d), "listings", "csv"))
    path = _stored(spark, RD.csv_records_as_json(raw), "listings-json", "text")
    return spark.read.text(path).withColumnRenamed("value", "json")


def _stream_files(spark, rows, name="purchases"):
    """Rows as Parquet files for a stream to read, a sink and a checkpoint, all in the shared folder."""
    from catalytics.session import scratch_path
    source = scratch_path(spark, name)
    rows.write.parquet(source)
    return source, scratch_path(spark, "sink"), scratch_path(spark, "stream")


def order_ingest_stream(spark, d):
    """U6 as a stream run to the end of its input (availableNow); the sink read back."""
    source, sink, state = _stream_files(spark, purchases(spark, d).select(*ST.PURCHASE_SCHEMA.names))
    ST.start_order_ingest(spark, source, sink, state).awaitTermination()
    return ST.read_orders(spark, sink).drop("ts")


def flat_orders(docs):
    """Order documents with the items as one text and the address in columns of its own."""
    return docs.select("order_id", "user_email", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"), "subtotal",
                       "shipping", "total", "payment_method", "delivery_speed", *[F.col(f"address.{c}").alias(f"address_{c}") for c in ST.ADDRESS_SCHEMA.names],
                       "status", "created_at")


def order_documents_stream(spark, d):
    """U6 over whole order requests, in two runs of the stream: the repeated requests come after a restart.

    The requests are put together and written once, repeated ones in a folder of their own.
    """
    from catalytics.session import scratch_path
    requests, sink, state = (scratch_path(spark, n) for n in ("requests", "sink", "stream"))
    source = f"{requests}/repeated=false"
    spark.createDataFrame([], ST.ORDER_SCHEMA).write.parquet(source)          # the folder is there without any request, too
    posted = X.order_requests(spark, d).withColumn("repeated", F.col("payment_method") == "repeat")
    posted.write.partitionBy("repeated").mode("append").parquet(requests)
    ST.start_order_documents(spark, source, sink, state).awaitTermination()
    spark.read.schema(posted.schema).parquet(requests).where("repeated").drop("repeated").write.mode("append").parquet(source)
    ST.start_order_documents(spark, source, sink, state).awaitTermination()
    return flat_orders(ST.read_order_documents(spark, sink))


def stream_units_stream(spark, d):
    """2.7 as a stream run to the end of its input; the sink's partial sums added up."""
    source, sink, state = _stream_files(spark, purchases(spark, d).select(*ST.PURCHASE_SCHEMA.names))
    ST.start_units_per_day(spark, source, sink, state).awaitTermination()
    return ST.read_units(spark, sink)


def two_arrivals(spark, d):
    """2.7 with event time over two runs: every third purchase (order_id % 3 = 0) comes in the second one, most of them late.

    Gives (closed days, sums of all purchases)."""
    rows, late = purchases(spark, d).select(*ST.PURCHASE_SCHEMA.names), F.col("order_id") % 3 == 0
    source, sink, state = _stream_files(spark, rows.where(~late))
    parts, parts_state = f"{sink}-parts", f"{state}-parts"
    for more in (None, rows.where(late)):
        if more is not None:
            more.write.mode("append").parquet(source)
        ST.start_closed_days(spark, source, sink, state).awaitTermination()
        ST.start_units_per_day(spark, source, parts, parts_state).awaitTermination()
    return ST.read_closed_days(spark, sink), ST.read_units(spark, parts)


def stream_units_reconciled(spark, d):
    closed, all_units = two_arrivals(spark, d)
    return ST.reconciled_days(closed, ST.late_units(closed, all_units))


def catalog_with_streamed_units(spark, d):
    """The catalog fed by the streamed units of the days from the middle of the log on."""
    return ST.with_streamed_units(catalog(spark, d), stream_units_stream(spark, d), FEED_SINCE)


def image_folder(spark, d):
    """The image files of the fixture, written in the shared folder."""
    from catalytics.session import scratch_path
    folder = scratch_path(spark, "images")
    IM.write_images(X.image_files(spark, d), folder)
    return folder


def image_manifest_stream(spark, d):
    """The manifest of a stream that meets the first versions in one run and their replacements in the next."""
    from catalytics.session import scratch_path
    folder, sink, state = (scratch_path(spark, n) for n in ("images", "sink", "stream"))
    files = X.image_files(spark, d)
    for part in (files.where("version = 0"), files.where("version > 0")):
        IM.write_images(part, folder)
        IM.start_manifest(spark, folder, sink, state).awaitTermination()
    return IM.read_manifest(spark, sink)


def stored_merge(spark, d, changes, job):
    """A change log merged into a stored listing table; the table read back."""
    from catalytics.session import scratch_path
    path = scratch_path(spark, "listing-store")
    SD.write_store(L.listing_view(listings(spark, d)).select(*L.LISTING_COLUMNS, F.lit(None).cast("string").alias("updated_on")), path)
    SD.merge(spark, path, changes, job)
    return SD.read_store(spark, path)


def period_quantiles(spark, d):
    """Price quartiles per category over some months, from stored monthly sketches; (quantiles, the exact rows of these months)."""
    lines = X.sold_lines(spark, d)
    stored = spark.read.parquet(_stored(spark, SK.period_sketches(lines, "categoryName", F.col("month"), "price"), "sketches", "parquet"))
    return SK.merged_quantiles(stored, "categoryName", *SKETCH_MONTHS), lines.where(F.col("month").between(*SKETCH_MONTHS))


def period_quantiles_checked(spark, d):
    """Rows of each category in the period, and whether every quartile's rank is within the stated error."""
    q, lines = period_quantiles(spark, d)
    return SK.rank_errors(lines, q, "categoryName", "price").select(
        F.col("categoryName").alias("category"), F.col("n").alias("count"), (F.col("worst") <= SK.RANK_ERROR).alias("within_error"))


def deep_page(spark, d):
    """Page 31 of the whole list by falling price, read from a page directory."""
    from catalytics.session import scratch_path
    path = scratch_path(spark, "product-list")
    SD.write_pages(R.listing_union(scored(spark, d), owned(spark, d)), R.listing_order("price_desc"), path)
    return SD.read_page(spark, path, SD.directory(spark, path), page=DEEP_PAGE, limit=5).drop("_src", "_lid")


def damaged_csv(spark, d):
    """The listings as a CSV file with unreadable prices, blank ids and lines that are cut short (id % 37 = 5)."""
    from catalytics.session import scratch_path
    rows = malformed(spark, d, blank_ids=True)
    line = F.to_csv(F.struct(*RD.LISTING_FIELDS))
    short = F.col("id").try_cast("bigint") % 37 == 5
    path = scratch_path(spark, "damaged")
    rows.select(F.when(short, F.substring_index(line, ",", 5)).otherwise(line).alias("value")).write.text(path)
    return path


def quarantine(spark, d):
    """(accepted, rejected) of the damaged file, both read back from their sinks."""
    from catalytics.session import scratch_path
    good, bad = scratch_path(spark, "accepted"), scratch_path(spark, "rejected")
    Q.load(spark, damaged_csv(spark, d), good, bad, RD.LISTING_FIELDS, Q.LISTING_TYPES, Q.LISTING_REQUIRED, header=False)
    return spark.read.parquet(good), spark.read.schema("reject_reason string, record string").json(bad)


def malformed(spark, d, blank_ids=False):
    """The listings with unreadable prices (id % 13 = 0) and, if asked, blank ids (id % 11 = 0)."""
    raw, n = listings(spark, d), F.col("id").cast("bigint")
    raw = raw.withColumn("price", F.when(n % 13 == 0, F.lit("N/A")).otherwise(F.col("price")))
    return raw.withColumn("id", F.when(n % 11 == 0, F.lit(" ")).otherwise(F.col("id"))) if blank_ids else raw


def invalid(spark, d):
    """The listings with some prices, stars and titles that break a rule."""
    n = F.col("id").cast("bigint")
    return listings(spark, d).withColumns({
        "price": F.when(n % 17 == 3, F.lit("0.0")).otherwise(F.col("price")),
        "stars": F.when(n % 19 == 4, F.lit("0.0")).when(n % 19 == 5, F.lit("6.0")).otherwise(F.col("stars")),
        "title": F.when(n % 23 == 6, F.lit(" ")).otherwise(F.col("title"))})


def requests(spark, d):
    """The listings as prediction requests, some with an empty or an unseen category."""
    n = F.col("id")
    return L.listing_view(listings(spark, d)).withColumn(
        "categoryName", F.when(n % 7 == 2, F.lit("")).when(n % 7 == 3, F.lit("zz new")).otherwise(F.col("categoryName")))


def raw_feed_with_terms(spark, d):
    """The raw feed with the excluded word in some titles, and a longer word that holds it in others."""
    key = F.regexp_extract("image", r"(\d+)", 1).cast("bigint")
    return raw_feed(spark, d).withColumn("productDisplayName", F.when(key % 9 == 4, F.concat("productDisplayName", F.lit(" Bra red")))
                                         .when(key % 9 == 5, F.concat("productDisplayName", F.lit(" Bracelet")))
                                         .otherwise(F.col("productDisplayName")))


def long_titles(spark, d):
    """The catalog with titles of up to seven more words, so that some pass the display limits."""
    return catalog(spark, d).withColumn("title", F.concat("title", F.expr("repeat(concat(' ', categoryName), cast(asin % 8 as int))")))


def fixed_clusters(spark, d):
    """The scored catalog with a fixed cluster (asin % 3), to check labels and summaries apart from the clustering."""
    return scored(spark, d).where(F.col("categoryName").isNotNull()).withColumn("cid", (F.col("asin") % 3).cast("int"))


def segmented(spark, d, block):
    """A block of the category view with the segment of each of its products."""
    c = scored(spark, d)
    return SM.with_segments(block(c), M.label_segments(M.category_clusters(c)))


def category_insights_segments(spark, d):
    """The category sentence with its clause on the Hot segment."""
    c = scored(spark, d)
    return IN.with_hot_segment(IN.category_insights(c), A.segment_summary(M.label_segments(M.category_clusters(c))))


def trend_labels(spark, d, cuts):
    g = A.category_rollup(scored(spark, d))
    return g.select(F.col("categoryName").alias("category"), "avg_demand_score",
                    S.trend_label("avg_score_exact", cuts).alias("trend"))


QUERIES.update({
    # ---- sources and sinks
    "scan_catalog_documents": lambda s, d: RD.read_catalog_documents(s, _stored(s, catalog_documents(s, d), "documents", "json")),
    "scan_with_fallback": lambda s, d: RD.with_fallback(catalog(s, d).where(F.col("asin") < 0), catalog(s, d)),
    "scan_without_fallback": lambda s, d: RD.with_fallback(catalog(s, d), catalog(s, d).withColumn("asin", -F.col("asin"))),
    "normalize_raw_feed": lambda s, d: RD.normalize_raw_feed(raw_feed(s, d)),
    "migrate_products_dedup": lambda s, d: RD.dedup_first(balanced(s, d), "asin", "copy")
                                             .withColumn("is_user_product", F.lit(False)).drop("copy"),
    "migrate_users_clean": lambda s, d: RD.clean_users(X.users_raw(s, d)),
    "asset_manifest": lambda s, d: L.asset_asins(X.asset_manifest_rows(s, d)),
    "quarantine_accepted": lambda s, d: quarantine(s, d)[0].select("asin", "id", "owner_email", "price", "stars", "boughtInLastMonth"),
    "quarantine_reasons": lambda s, d: quarantine(s, d)[1].groupBy("reject_reason").agg(F.count("*").alias("count")),
    "stored_listing_updates": lambda s, d: stored_merge(s, d, X.listing_updates_log(s, d), C.stored_updates),
    "stored_listing_deletes": lambda s, d: stored_merge(s, d, X.listing_deletes_log(s, d), C.stored_deletes).drop("updated_on"),
    "product_listing_deep": deep_page,
    "period_price_quantiles": lambda s, d: period_quantiles(s, d)[0].select(
        F.col("categoryName").alias("category"), "n", *[S.round_half(F.col("q")[i], 2).alias(c) for i, c in enumerate(("q1", "median", "q3"))]),
    "period_price_quantiles_checked": period_quantiles_checked,
    "image_manifest": lambda s, d: IM.manifest(IM.read_images(s, image_folder(s, d))),
    "image_manifest_stream": image_manifest_stream,
    "image_uploads": lambda s, d: IM.upload_requests(X.upload_files(s, d)).select("id", "owner_email", "filename", "image_filename", "content_type", "reject_reason"),
    "write_training_csv": write_training_csv,
    "csv_to_json": csv_to_json,
    "collection_counts": lambda s, d: RD.collection_counts({
        "products": catalog(s, d), "users": X.users(s, d), "user_products": L.listing_view(listings(s, d)),
        "orders": X.stored_orders(s, d), "gridfs_files": X.asset_manifest_rows(s, d)}),
    "dataset_info": lambda s, d: RD.stored_dataset_info(s, _stored(s, balanced(s, d).drop("copy"), "training", "csv")),
    # ---- scalar functions and predicates
    "demand_score_clipped": lambda s, d: M.listing_features(L.listing_view(listings(s, d)), catalog(s, d))
                                           .select("asin", S.round_half(S.clip(S.composite(
                                               "stars_norm", "bought_norm", "bs_norm", "price_norm")), 2)
                                               .alias("demand_score")),
    "listing_quick_score": lambda s, d: L.listing_view(listings(s, d)).select("asin", S.quick_score().alias("score")),
    "seller_panel_score": lambda s, d: L.parse_listings(listings(s, d)).select(
        "asin", S.seller_panel_score(P.js_parse_float("stars_raw"), P.js_parse_int("bought_raw")).alias("score")),
    "legacy_score": lambda s, d: catalog(s, d).select("asin", S.legacy_score().alias("legacy_score")),
    "confidence": lambda s, d: scored(s, d).select("asin", S.confidence().alias("confidence"),
                                                   S.confidence(divisor=200.0).alias("confidence_category")),
    "trend_label": lambda s, d: trend_labels(s, d, S.TREND_CUTS),
    "trend_label_legacy": lambda s, d: trend_labels(s, d, S.TREND_CUTS_LEGACY),
    "filter_search_regex": lambda s, d: scored(s, d).where(P.catalog_filter(search=REGEX_PATTERN))
                                                    .select("asin", "title"),
    "filter_search_literal": lambda s, d: L.listing_view(listings(s, d))
                                           .where(P.catalog_filter(search=LITERAL_WORD, literal=True))
                                           .select("asin", "title"),
    "filter_equality": lambda s, d: scored(s, d).where(P.catalog_filter(category=EQ_CATEGORY, bestseller=True))
                                                .select("asin", "categoryName", "isBestSeller"),
    "filter_range": lambda s, d: scored(s, d).where(P.catalog_filter(min_price=950.0, max_price=990.5,
                                                                     min_stars=3.5))
                                             .select("asin", "price", "stars"),
    "filter_excluded_terms": lambda s, d: P.excluded_terms(RD.normalize_raw_feed(raw_feed_with_terms(s, d))),
    "reorder_predicate": lambda s, d: scored(s, d).where(P.reorder_predicate())
                                                  .select("asin", "demand_score", "boughtInLastMonth"),
    "skip_malformed_rows": lambda s, d: L.listing_view(malformed(s, d))
                                         .select("asin", "price", "stars", "boughtInLastMonth"),
    "safe_projection": lambda s, d: C.safe_projection(X.users(s, d)),
    "title_truncate": lambda s, d: long_titles(s, d).select("asin", F.substring("title", 1, 45).alias("title_45"),
                                                        F.substring("title", 1, 30).alias("title_30")),
    "synthesize_fields": lambda s, d: RD.synthesize_fields(RD.normalize_raw_feed(raw_feed(s, d))),
    # ---- sampling and ML
    "scatter_sample": lambda s, d: SM.scatter_sample(scored(s, d), 1200),
    "category_price_samples": lambda s, d: SM.category_price_samples(scored(s, d), 10, 400),
    "category_scatter": lambda s, d: SM.category_scatter(scored(s, d), 300),
    "catalog_downsample": lambda s, d: SM.downsample(catalog(s, d), 10000),
    "category_price_samples_small": lambda s, d: SM.category_price_samples(scored(s, d), 10, 20),
    "category_scatter_small": lambda s, d: SM.category_scatter(scored(s, d), 10),
    "catalog_downsample_small": lambda s, d: SM.downsample(catalog(s, d), 100),
    "balance_classes": balanced,
    "stratified_split": lambda s, d: split_frame(s, d).select("asin", "demand_level", "split"),
    "label_encode": lambda s, d: SM.label_encode(scored(s, d)),
    "standardize": standardized,
    "class_distribution": lambda s, d: A.class_distribution(training(s, d)),
    "quick_score_metrics": lambda s, d: M.quick_score_metrics(scored(s, d)),
    "train_demand_model": lambda s, d: M.training_summary(scored(s, d)),
    "model_stats": lambda s, d: M.model_stats(scored(s, d)),
    "adam_model_stats": lambda s, d: M.adam_model_stats(scored(s, d)),
    "predict_demand": lambda s, d: M.predict_demand(M.train_demand_model(scored(s, d))[0], catalog(s, d),
                                                    L.listing_view(listings(s, d))),
    "request_features": lambda s, d: M.request_features(requests(s, d), catalog(s, d)),
    "category_segments": lambda s, d: M.category_segments(scored(s, d)),
    # segment_label_map and segment_summary are checks of labels and summary over a fixed assignment, not of the clustering
    "segment_label_map": lambda s, d: M.label_segments(fixed_clusters(s, d))
                                        .groupBy("categoryName", F.col("cid").alias("cluster"), "segment").agg(F.count("*").alias("n")),
    "segment_summary": lambda s, d: A.segment_summary(M.label_segments(fixed_clusters(s, d))),
    "category_top_segments": lambda s, d: segmented(s, d, lambda c: R.category_top(c, 10)),
    "category_bottom_segments": lambda s, d: segmented(s, d, lambda c: R.category_bottom(c, 5)),
    "category_scatter_segments": lambda s, d: segmented(s, d, lambda c: SM.category_scatter(c, 300)),
    "category_insights_segments": category_insights_segments,
    # the same joins over a fixed assignment, which SQL can follow
    "category_scatter_fixed_segments": lambda s, d: SM.with_segments(SM.category_scatter(scored(s, d), 300), M.label_segments(fixed_clusters(s, d))),
    "category_segment_summary": lambda s, d: A.segment_summary(M.label_segments(M.category_clusters(scored(s, d)))),
    "seller_panel": lambda s, d: A.seller_panel(L.parse_listings(listings(s, d))),
    # ---- change logs and streams (batch form)
    "listing_updates": lambda s, d: C.listing_updates(listings(s, d), X.listing_updates_log(s, d)),
    "listing_deletes": lambda s, d: C.listing_deletes(listings(s, d), X.listing_deletes_log(s, d)),
    "profile_updates": lambda s, d: C.profile_updates(X.users(s, d), X.profile_updates_log(s, d)),
    "profile_passwords": lambda s, d: C.merged_profiles(X.users(s, d), X.profile_updates_log(s, d)).select("email", "password_hash"),
    "duplicate_registration": lambda s, d: C.duplicate_registration(X.users(s, d), X.registrations_log(s, d)),
    "registration_outcomes": lambda s, d: C.registration_outcomes(X.users(s, d), X.registrations_log(s, d)),
    "seller_activity_merge": lambda s, d: C.seller_activity_merge(listings(s, d), X.image_uploads_log(s, d)),
    "order_ingest": lambda s, d: ST.ingest_orders(purchases(s, d)).drop("ts"),
    "stream_units_tumbling": lambda s, d: ST.units_per_day(purchases(s, d)),
    "order_ingest_stream": order_ingest_stream,
    "stream_units_stream": stream_units_stream,
    "order_documents": lambda s, d: flat_orders(ST.ingest_order_requests(X.order_requests(s, d))),
    "order_documents_stream": order_documents_stream,
    "stream_units_closed": lambda s, d: two_arrivals(s, d)[0],
    "stream_units_late": lambda s, d: ST.late_units(*two_arrivals(s, d)),
    "stream_units_reconciled": stream_units_reconciled,
    "catalog_with_streamed_units": catalog_with_streamed_units,
})


# ---------------------------------------------------------------- insight sentences
from catalytics.operators import insights as IN  # noqa: E402

QUERIES.update({
    "category_distribution_insights": lambda s, d: IN.category_distribution_insights(scored(s, d), 12),
    "price_distribution_insights": lambda s, d: IN.price_distribution_insights(scored(s, d), 10),
    "demand_insights": lambda s, d: IN.demand_insights(scored(s, d)),
    "ratings_insights": lambda s, d: IN.ratings_insights(scored(s, d), 1200),
    "monthly_insights_text": lambda s, d: IN.monthly_insights_text(A.monthly_units(s, d)),
    "correlation_insights": lambda s, d: IN.correlation_insights(scored(s, d)),
})

QUERIES.update({
    "trend_texts": lambda s, d: IN.trend_texts(A.trends(scored(s, d), 20, ranked=True)),
    "category_insights": lambda s, d: IN.category_insights(scored(s, d)),
})

"""Global and grouped aggregates over the scored catalog.

All grouped aggregates use partial (map-side) aggregation, so a category that
holds a third of the rows costs one partial row per input partition, not one
task.  Per-group outputs limited to top N use a deterministic tie-break.
Sums and means of columns with few decimals are exact (bigint units summed,
one decimal division per group), so results do not depend on merge order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalytics.functions.scalars import join_by_share, with_row
from catalytics.operators.quantiles import counted_values, value_quantiles
from catalytics.functions import scores as S
from catalytics.functions.predicates import reorder_predicate

CAT = "categoryName"


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small fixed table built as JVM literals (no Python-side data transfer)."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _grouped(df: DataFrame) -> DataFrame:
    # pandas groupby drops null keys
    return df.where(F.col(CAT).isNotNull())


def _int_sum(c) -> F.Column:
    return F.sum(F.col(c).cast("int") if isinstance(c, str) else c.cast("int")).cast("bigint")


def stats(scored: DataFrame) -> DataFrame:
    """A1: dataset KPIs in one row."""
    return scored.agg(
        F.count("*").alias("total_products"),
        F.countDistinct(CAT).alias("total_categories"),
        F.coalesce(_int_sum("isBestSeller"), F.lit(0).cast("bigint")).alias("best_sellers"),
        S.exact_avg("price").alias("avg_price"),
        S.exact_avg("stars").alias("avg_stars"),
        S.exact_avg("demand_score").alias("avg_demand_score"),
        S.round_half(F.min("price"), 2).alias("price_min"),
        S.round_half(F.max("price"), 2).alias("price_max"))


def summary(scored: DataFrame) -> DataFrame:
    """A2: dashboard KPI strip."""
    return scored.agg(
        F.count("*").alias("total_products"),
        F.countDistinct(CAT).alias("total_categories"),
        F.coalesce(_int_sum("isBestSeller"), F.lit(0).cast("bigint")).alias("best_sellers"),
        F.count_if(F.col("demand_level") == "High").alias("high_demand_count"),
        S.exact_avg("price").alias("avg_price"),
        S.exact_avg("stars").alias("avg_stars"),
        S.exact_avg("demand_score").alias("avg_demand"),
        F.coalesce(F.sum("boughtInLastMonth"), F.lit(0).cast("bigint")).alias("total_units_month"))


def category_rollup(scored: DataFrame) -> DataFrame:
    """Per-category count, exact mean score/stars/price, units, bestsellers."""
    return (_grouped(scored).groupBy(CAT).agg(
        F.count("asin").alias("product_count"),
        S.exact_mean("demand_score").alias("avg_score_exact"),
        S.exact_avg("demand_score").alias("avg_demand_score"),
        S.exact_avg("stars").alias("avg_stars"),
        S.exact_avg("price").alias("avg_price"),
        F.sum("boughtInLastMonth").alias("total_bought"),
        _int_sum("isBestSeller").alias("best_sellers")))


def trends(scored: DataFrame, top: int = 20, ranked: bool = False) -> DataFrame:
    """A3: top-N categories by mean demand score with a trend label.

    Label and order use the exact mean, as the reference does.  ``ranked`` adds the
    place in that order, for views that sort again and must keep it among equals.
    """
    g = category_rollup(scored)
    best = g.orderBy(F.col("avg_score_exact").desc(), F.col(CAT).asc()).limit(top)
    columns = [F.col(CAT).alias("category"), "product_count", "avg_demand_score", "avg_stars",
               "total_bought", "best_sellers", S.trend_label("avg_score_exact").alias("trend")]
    if ranked:                                            # over at most ``top`` rows
        columns.append(F.row_number().over(Window.orderBy(F.col("avg_score_exact").desc(), F.col(CAT).asc())).alias("rank"))
    return best.select(*columns)


def trend_cards(trend_rows: DataFrame) -> DataFrame:
    """A4: cards over the trend rows: #Surging, #Rising, units, mean of means."""
    return trend_rows.agg(
        F.count_if(F.col("trend") == "Surging").alias("surging"),
        F.count_if(F.col("trend") == "Rising").alias("rising"),
        F.coalesce(F.sum("total_bought"), F.lit(0).cast("bigint")).alias("total_units"),
        S.exact_avg("avg_demand_score").alias("avg_score"))


def trend_recommendation(trend_rows: DataFrame) -> DataFrame:
    """A5: category with the best avg*0.7 + units*0.0003 and the top-5 names.

    Works over the (at most 126) rows of ``trends(ranked=True)``; ties keep the trend order, like a stable sort.
    """
    r = trend_rows.withColumn("composite", F.col("avg_demand_score") * S.RECOMMEND_SCORE_WEIGHT
                              + F.col("total_bought") * S.RECOMMEND_UNITS_WEIGHT)
    top1 = (r.orderBy(F.col("composite").desc(), F.col("rank").asc())
             .limit(1).select(F.col("category").alias("recommended"), S.round_half("composite", 4).alias("composite")))
    top5 = (r.where(F.col("rank") <= 5).agg(F.sort_array(F.collect_list(F.struct("rank", "category"))).alias("s"))
             .select(F.concat_ws(", ", F.col("s.category")).alias("top5")))
    return with_row(top1, top5)


def category_distribution(scored: DataFrame, top: int = 12) -> DataFrame:
    """A6 rows: top-N categories by product count with their share %."""
    g = _grouped(scored).groupBy(CAT).agg(F.count("*").alias("count"))
    total = g.agg(F.sum("count").alias("total"))
    return (with_row(g.orderBy(F.col("count").desc(), F.col(CAT).asc()).limit(top), total)
             .select(F.col(CAT).alias("category"), "count",
                     S.round_half(F.col("count") / F.col("total") * 100, 1).alias("share_pct")))


def category_distribution_summary(scored: DataFrame, top: int = 12) -> DataFrame:
    """A6 insights: leader, leader share %, top-N share %, distinct categories."""
    g = _grouped(scored).groupBy(CAT).agg(F.count("*").alias("count"))
    ranked = g.orderBy(F.col("count").desc(), F.col(CAT).asc()).limit(top)
    top_agg = ranked.agg(F.sum("count").alias("top_count"))
    leader = (ranked.orderBy(F.col("count").desc(), F.col(CAT).asc()).limit(1)
                    .select(F.col(CAT).alias("leader"), F.col("count").alias("leader_count")))
    totals = g.agg(F.sum("count").alias("total"), F.count("*").alias("distinct_categories"))
    return (with_row(with_row(leader, top_agg), totals)
                  .select("leader", "leader_count",
                          S.round_half(F.col("leader_count") / F.col("total") * 100, 1).alias("leader_pct"),
                          S.round_half(F.col("top_count") / F.col("total") * 100, 1).alias("top_share_pct"),
                          "distinct_categories"))


def top_categories(scored: DataFrame, top: int) -> DataFrame:
    """The N most frequent categories (value_counts().head(N)), names only."""
    g = _grouped(scored).groupBy(CAT).agg(F.count("*").alias("n"))
    return g.orderBy(F.col("n").desc(), F.col(CAT).asc()).limit(top).select(CAT)


def price_keep(scored: DataFrame, top: int = 10) -> DataFrame:
    """Rows of the top-N categories (left semi join against N names).

    N <= 30 by the API contract, so the broadcast side is size-bounded.
    """
    return scored.join(F.broadcast(top_categories(scored, top)), CAT, "left_semi")


def price_distribution(scored: DataFrame, top: int = 10, ranked: bool = False) -> DataFrame:
    """Price five-number summary + mean per top-N category, by median desc.

    Equal prices are counted once and written; the quartiles are exact (linear interpolation)
    and distributed, see ``value_quantiles``.
    ``ranked`` adds the place by the exact median.
    """
    values = counted_values(price_keep(scored, top), CAT, "price")
    times = F.col("m").cast("decimal(20,0)")
    mean = F.sum((F.col("v").cast("decimal(18,6)") * times).cast("decimal(38,6)")) / F.sum(times)
    g = values.groupBy(CAT).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.round(mean, 2).cast("double").alias("mean"), F.sum("m").alias("count"))
    q = value_quantiles(values, CAT, (0.25, 0.5, 0.75), few_keys=True)
    out = g.join(F.broadcast(q), CAT).select(F.col(CAT).alias("category"), S.round_half("min", 2).alias("min"), S.round_half(F.col("q")[0], 2).alias("q1"),
                                S.round_half(F.col("q")[1], 2).alias("median"), S.round_half(F.col("q")[2], 2).alias("q3"),
                                S.round_half("max", 2).alias("max"), "mean", "count", F.col("q")[1].alias("_median"))
    order = [F.col("_median").desc(), F.col("category").asc()]
    if ranked:                                            # over at most ``top`` rows
        out = out.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return out.orderBy(*order).drop("_median")


def demand_mix(scored: DataFrame) -> DataFrame:
    """Count and % per level; all three levels always present."""
    spark = scored.sparkSession
    dim = literal_rows(spark, ["demand_level", "ord"], [(lvl, i) for i, lvl in enumerate(S.LEVELS)])
    # one row per level: demand_level is a three-way CASE, so this side is bounded
    counts = F.broadcast(scored.groupBy("demand_level").agg(F.count("*").alias("cnt")))
    j = dim.join(counts, "demand_level", "left").select(
        F.col("demand_level").alias("level"), "ord", F.coalesce("cnt", F.lit(0).cast("bigint")).alias("count"))
    total = j.agg(F.greatest(F.sum("count"), F.lit(1)).alias("total"))
    return (with_row(j, total)
             .select("level", "count", S.round_half(F.col("count") / F.col("total") * 100, 1).alias("pct"), "ord")
             .orderBy("ord").drop("ord"))


def demand_bubble(scored: DataFrame, top: int = 15) -> DataFrame:
    """Per-category mean price/score/stars and count; top 15 by count."""
    g = category_rollup(scored)
    return (g.orderBy(F.col("product_count").desc(), F.col(CAT).asc()).limit(top)
             .select(F.col(CAT).alias("category"), "avg_price",
                     F.col("avg_demand_score").alias("avg_demand"), "avg_stars",
                     F.col("product_count").alias("count")))


CORR_COLUMNS = [("price", "Price"), ("stars", "Rating"), ("boughtInLastMonth", "Units Sold"),
                ("demand_score", "Demand Score")]


def correlation_matrix(scored: DataFrame) -> DataFrame:
    """A10: Pearson matrix (long form) from one aggregate pass."""
    aggs, pairs = [], []
    for i, (a, la) in enumerate(CORR_COLUMNS):
        for j, (b, lb) in enumerate(CORR_COLUMNS):
            if i < j:
                aggs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}{j}"))
    row = scored.agg(*aggs)
    entries = []
    for i, (a, la) in enumerate(CORR_COLUMNS):
        for j, (b, lb) in enumerate(CORR_COLUMNS):
            if i == j:
                v = F.lit(1.0)
            else:
                v = F.col(f"c{min(i, j)}{max(i, j)}")
            entries.append(F.struct(F.lit(la).alias("row_label"), F.lit(lb).alias("col_label"),
                                    F.lit(i).alias("i"), F.lit(j).alias("j"), S.round_half(v, 3).alias("r")))
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def correlation_pairs(scored: DataFrame) -> DataFrame:
    """A10 insights: the six off-diagonal pairs ranked by |r| (1 = strongest)."""
    m = correlation_matrix(scored).where(F.col("i") < F.col("j"))
    return m.select("row_label", "col_label", "r").withColumn("abs_r", F.abs("r"))


def price_rating_corr(scored: DataFrame) -> DataFrame:
    """corr(price, stars), its verbal bucket, and #stars >= 4.5."""
    c = F.col("corr")
    bucket = (F.when(c >= 0.6, "strong positive").when(c >= 0.3, "moderate positive")
               .when(c > 0, "weak positive").when(c > -0.3, "weak negative")
               .when(c > -0.6, "moderate negative").otherwise("strong negative"))
    return (scored.agg(F.corr("price", "stars").alias("corr"),
                       F.count_if(F.col("stars") >= 4.5).alias("high_rated"),
                       F.count("*").alias("total"))
                  .select(S.round_half("corr", 3).alias("corr"), bucket.alias("bucket"), "high_rated", "total"))


def inventory_metrics(scored: DataFrame, limit: int = 30) -> DataFrame:
    """Totals, mean score, level counts, and the alert count after LIMIT."""
    return scored.agg(
        F.count("*").alias("total_products"),
        F.coalesce(_int_sum("isBestSeller"), F.lit(0).cast("bigint")).alias("best_sellers"),
        S.exact_avg("demand_score").alias("avg_demand_score"),
        F.least(F.count_if(reorder_predicate()), F.lit(limit).cast("bigint")).alias("reorder_alerts"),
        F.count_if(F.col("demand_score") >= 60).alias("high_demand"),
        F.count_if((F.col("demand_score") >= 35) & (F.col("demand_score") < 60)).alias("medium_demand"),
        F.count_if(F.col("demand_score") < 35).alias("low_demand"))


def inventory_categories(scored: DataFrame, top: int = 15) -> DataFrame:
    """Per-category count, mean score, units; top 15 by units."""
    g = category_rollup(scored)
    return (g.orderBy(F.col("total_bought").desc(), F.col(CAT).asc()).limit(top)
             .select(F.col(CAT).alias("category"), F.col("product_count").alias("count"),
                     F.col("avg_demand_score").alias("avg_score"), "total_bought"))


def category_stats(scored: DataFrame) -> DataFrame:
    """The 12 KPIs of the category view, for every category at once."""
    return _grouped(scored).groupBy(CAT).agg(
        F.count("*").alias("product_count"),
        S.exact_avg("price").alias("avg_price"),
        S.exact_avg("stars").alias("avg_stars"),
        S.exact_avg("demand_score").alias("avg_demand_score"),
        F.sum("boughtInLastMonth").alias("total_bought"),
        _int_sum("isBestSeller").alias("best_sellers"),
        S.round_half(F.min("price"), 2).alias("price_min"),
        S.round_half(F.max("price"), 2).alias("price_max"),
        S.round_half(F.max("demand_score"), 2).alias("max_demand_score"),
        F.count_if(F.col("demand_score") >= 60).alias("high_demand_count"),
        F.count_if((F.col("demand_score") >= 35) & (F.col("demand_score") < 60)).alias("medium_demand_count"),
        F.count_if(F.col("demand_score") < 35).alias("low_demand_count"),
    ).withColumnRenamed(CAT, "category")


N_PRICE_BUCKETS = 5


def price_buckets(scored: DataFrame, n_buckets: int = N_PRICE_BUCKETS) -> DataFrame:
    """Equal-width price buckets [lo, hi) per category; the maximum price
    falls outside the last bucket, as in the reference.  Zero buckets kept.

    Per-category min/max is an aggregate joined back (AQE broadcasts it when
    small) instead of a window, so a hot category is not pulled into one task.
    The bucket is found arithmetically and confirmed against the reference's
    float edges (pmin + i*width), checking the neighbours for edge cases.
    """
    g = _grouped(scored)
    mm = g.groupBy(CAT).agg(F.min("price").alias("pmin"), F.max("price").alias("pmax")) \
          .withColumn("bsize", F.when(F.col("pmax") > F.col("pmin"),
                                      (F.col("pmax") - F.col("pmin")) / float(n_buckets)).otherwise(F.lit(1.0)))
    # equal prices are counted before any row meets its category's edges, and a category's prices are dealt over many tasks
    priced = g.groupBy(CAT, "price").agg(F.count("*").alias("n"))
    j = join_by_share(priced, mm, CAT, "price")
    b0 = F.floor((F.col("price") - F.col("pmin")) / F.col("bsize"))

    def inside(k):
        return ((k >= 0) & (k < n_buckets)
                & (F.col("price") >= F.col("pmin") + k * F.col("bsize"))
                & (F.col("price") < F.col("pmin") + (k + 1) * F.col("bsize")))
    bucket = F.when(inside(b0), b0).when(inside(b0 - 1), b0 - 1).when(inside(b0 + 1), b0 + 1)
    counts = j.select(CAT, bucket.alias("bucket"), "n").where(F.col("bucket").isNotNull()) \
              .groupBy(CAT, "bucket").agg(F.sum("n").alias("count"))
    dim = mm.select(CAT, "pmin", "bsize", F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1))).alias("bucket"))
    lo = F.col("pmin") + F.col("bucket") * F.col("bsize")
    hi = F.col("pmin") + (F.col("bucket") + 1) * F.col("bsize")
    return (dim.join(counts, [CAT, "bucket"], "left")
               .select(F.col(CAT).alias("category"), F.col("bucket").cast("int").alias("bucket"),
                       F.format_string("₹%d-%d", lo.cast("bigint"), hi.cast("bigint")).alias("label"),
                       F.coalesce("count", F.lit(0).cast("bigint")).alias("count")))


def stars_histogram(scored: DataFrame) -> DataFrame:
    """Per category, counts of stars in [s, s+1) for s = 1..5, zeros kept."""
    g = _grouped(scored)
    counts = (g.where((F.col("stars") >= 1) & (F.col("stars") < 6))
               .groupBy(CAT, F.floor("stars").cast("int").alias("stars"))
               .agg(F.count("*").alias("count")))
    cats = g.select(CAT).distinct()
    dim = cats.select(CAT, F.explode(F.sequence(F.lit(1), F.lit(5))).alias("stars"))
    return (dim.join(counts, [CAT, "stars"], "left")
               .select(F.col(CAT).alias("category"), "stars",
                       F.coalesce("count", F.lit(0).cast("bigint")).alias("count")))


def segment_summary(segmented: DataFrame) -> DataFrame:
    """Per (category, segment) count, means, units, bestsellers."""
    return (segmented.groupBy(CAT, "segment").agg(
        F.count("*").alias("count"),
        S.exact_avg("demand_score").alias("avg_demand_score"),
        S.exact_avg("price").alias("avg_price"),
        S.exact_avg("stars").alias("avg_stars"),
        F.sum("boughtInLastMonth").alias("total_bought"),
        _int_sum("isBestSeller").alias("best_sellers")))


def predictions_summary(prediction_rows: DataFrame) -> DataFrame:
    """Level counts and mean score over the returned prediction rows."""
    return prediction_rows.agg(
        F.count_if(F.col("demand_level") == "High").alias("High"),
        F.count_if(F.col("demand_level") == "Medium").alias("Medium"),
        F.count_if(F.col("demand_level") == "Low").alias("Low"),
        S.exact_avg("demand_score").alias("avg_score"))


def seller_panel(listings_parsed: DataFrame) -> DataFrame:
    """Per owner: listings, High/Medium/Low counts by the seller score,
    rounded mean score, floor(mean price)."""
    from catalytics.functions.predicates import js_parse_float, js_parse_int
    s = listings_parsed.select(
        "owner_email",
        S.seller_panel_score(js_parse_float("stars_raw"), js_parse_int("bought_raw")).alias("panel_score"),
        js_parse_float("price_raw").alias("price_num"))
    g = s.groupBy("owner_email").agg(F.count("*").alias("n"),
                                     F.count_if(F.col("panel_score") >= 60).alias("high"),
                                     F.count_if((F.col("panel_score") >= 35) & (F.col("panel_score") < 60))
                                     .alias("medium"),
                                     F.count_if(F.col("panel_score") < 35).alias("low"),
                                     F.sum("panel_score").alias("score_sum"),
                                     S.exact_mean("price_num").alias("mean_price"))
    return g.select("owner_email", F.col("n").alias("listings"), F.col("high").alias("high_count"),
                    F.col("medium").alias("medium_count"), F.col("low").alias("low_count"),
                    F.floor(F.col("score_sum") / F.col("n") + 0.5).alias("avg_score"),
                    F.floor("mean_price").cast("bigint").alias("avg_price"))


def class_distribution(training: DataFrame) -> DataFrame:
    """Level counts before and after balancing, from one count per level.

    Balancing brings every level that has rows to the largest count (M5), so no copy is made to count it.
    """
    sizes = training.groupBy("demand_level").agg(F.count("*").alias("n"))
    both = with_row(sizes, sizes.agg(F.max("n").alias("most")))
    stages = F.array(F.struct(F.lit("before").alias("stage"), F.col("n").alias("count")), F.struct(F.lit("after").alias("stage"), F.col("most").alias("count")))
    return both.select("demand_level", F.inline(stages)).select("stage", "demand_level", "count")


def monthly_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21 (re-aimed): measured units and revenue per month of l_shipdate."""
    from catalytics.sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem").select("l_shipdate", "l_quantity", "l_extendedprice")
    # group on the truncated timestamp; format only the result rows
    return (li.groupBy(F.date_trunc("month", "l_shipdate").alias("m"))
              .agg(F.sum("l_quantity").cast("bigint").alias("units"),
                   S.exact_sum("l_extendedprice").alias("revenue"),
                   F.count("*").alias("lines"))
              .select(F.date_format("m", "yyyy-MM").alias("month"), "units", "revenue", "lines"))


def monthly_insights(monthly: DataFrame) -> DataFrame:
    """Peak month (earliest on ties), first-to-last growth % (denominator
    >= 1), Q4 share %.  One aggregate over the monthly rows."""
    m = (monthly.withColumn("mon", F.substring("month", 6, 2).cast("int"))
                .withColumn("month_key", F.substring("month", 1, 4).cast("int") * 12 + F.col("mon")))
    return m.agg(
        F.max_by("month", F.struct(F.col("units"), -F.col("month_key"))).alias("peak_month"),
        F.max("units").alias("peak_units"),
        F.min_by("units", "month").alias("first_units"),
        F.max_by("units", "month").alias("last_units"),
        F.sum(F.when(F.col("mon") >= 10, F.col("units")).otherwise(F.lit(0).cast("bigint"))).alias("q4_units"),
        F.sum("units").alias("total_units"),
    ).select(
        "peak_month", "peak_units", "first_units", "last_units",
        S.round_half((F.col("last_units") - F.col("first_units"))
                / F.greatest(F.col("first_units"), F.lit(1)) * 100, 1).alias("growth_pct"),
        S.round_half(F.col("q4_units") / F.col("total_units") * 100, 1).alias("q4_share_pct"))


# The seasonal weights of the monthly trend, Jan..Dec.
SEASONAL_WEIGHTS = (0.78, 0.82, 0.92, 0.97, 1.02, 1.04, 1.03, 1.06, 1.08, 1.18, 1.32, 1.42)
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def seasonal_allocation(scored: DataFrame) -> DataFrame:
    """The catalog's monthly units spread over 12 months by fixed weights."""
    spark = scored.sparkSession
    total_w = sum(SEASONAL_WEIGHTS)
    dim = literal_rows(spark, ["month_no", "month", "weight"],
                       [(i + 1, MONTH_NAMES[i], float(w)) for i, w in enumerate(SEASONAL_WEIGHTS)])
    total = scored.agg(F.coalesce(F.sum("boughtInLastMonth"), F.lit(0).cast("bigint")).alias("total_units"))
    return (with_row(dim, total)
             .select("month_no", "month",
                     S.round_half(F.col("total_units") * (F.col("weight") / total_w), 0).cast("bigint").alias("units")))


def order_totals(orders: DataFrame) -> DataFrame:
    """Items, subtotal, shipping (50 for express), total per order."""
    return orders.select("order_id", "items",
                         S.round_half("subtotal", 2).alias("subtotal"), "shipping",
                         S.round_half("total", 2).alias("total"), "delivery_speed")

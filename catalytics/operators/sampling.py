"""Deterministic sampling, class balancing, stratified split, encoding and
standardization (M1-M8).

Random draws are replaced by an md5(asin) order, which any engine evaluates
identically, so samples are reproducible and checkable.  Per-class ranks use
``bucketed_row_number`` (md5-prefix buckets), so a class holding most rows is
still ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalytics.functions.scalars import JOIN_SHARES, with_row
from catalytics.functions import scores as S
from catalytics.operators.aggregates import price_keep
from catalytics.operators.listings import TRAINING_COLUMNS
from catalytics.operators.ranking import bucketed_row_number, md5_bucket, md5_key, top_per_group

CAT = "categoryName"
SPLIT_TRAIN_FRACTION = 0.8
COPY_CHUNK = 1000          # copies of one row made at a time
RANK_BUCKET_HEX = 4        # 16**4 = 65,536 buckets per class for exact ranks: 1.5 million rows each in 10^11


def scatter_sample(scored: DataFrame, n: int = 1200) -> DataFrame:
    """M1: min(n, rows) rows in md5 order (a top-n, no full sort)."""
    return (scored.orderBy(md5_key(), F.col("asin")).limit(n)
                  .select("asin", S.round_half("price", 2).alias("price"), "stars",
                          F.col(CAT).alias("category"), S.round_half("demand_score", 1).alias("demand")))


def category_price_samples(scored: DataFrame, top: int = 10, cap: int = 400) -> DataFrame:
    """M2: at most ``cap`` prices per top-N category, without replacement."""
    t = top_per_group(price_keep(scored, top), CAT, [md5_key(), F.col("asin")], cap)
    return t.select(F.col(CAT).alias("category"), "asin", S.round_half("price", 2).alias("price"))


def category_scatter(scored: DataFrame, cap: int = 300) -> DataFrame:
    """M3: at most ``cap`` points per category (price, score, short title)."""
    t = top_per_group(scored.where(F.col(CAT).isNotNull()), CAT, [md5_key(), F.col("asin")], cap)
    return t.select(F.col(CAT).alias("category"), "asin", S.round_half("price", 2).alias("x"),
                    S.round_half("demand_score", 2).alias("y"), F.substring("title", 1, 45).alias("title"))


def with_segments(block: DataFrame, segments: DataFrame) -> DataFrame:
    """A block of products (by asin) with the segment of each; no segment where a product was not clustered."""
    return block.join(segments.select("asin", "segment"), "asin", "left")


def downsample(df: DataFrame, n: int = 10000, key: str = "asin") -> DataFrame:
    """M4: keep n rows when larger (md5 order of the key)."""
    return df.orderBy(md5_key(key), F.col(key)).limit(n)


def class_rank(df: DataFrame, label: str = "demand_level", key: str = "asin", out: str = "r") -> DataFrame:
    """Exact 1-based rank of each row inside its class by (md5(key), key)."""
    return bucketed_row_number(df, [label], md5_bucket(key, RANK_BUCKET_HEX), [md5_key(key), F.col(key)],
                               out=out, bucket_bound=16 ** RANK_BUCKET_HEX)


def balance_classes(training: DataFrame, label: str = "demand_level") -> DataFrame:
    """M5: upsample every present class to the majority count, keep originals.

    Deterministic: the row ranked r (of n) in its class gets
    ``max div n + (r <= max mod n)`` copies, so every class ends with exactly
    ``max`` rows.  Class counts are a small aggregate broadcast to all tasks.
    """
    counts = training.groupBy(label).agg(F.count("*").alias("_n"))
    mx = counts.agg(F.max("_n").alias("_max"))
    sizes = F.broadcast(with_row(counts, mx))           # one row per class
    r = class_rank(training, label).join(sizes, label)
    copies = F.expr("_max div _n") + F.when(F.col("r") <= F.col("_max") % F.col("_n"), 1).otherwise(0)
    # two levels, so that no row carries an array as long as the ratio of the class sizes
    chunk = F.lit(COPY_CHUNK).cast("bigint")
    r = r.withColumn("_copies", copies).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_copies - 1) div {COPY_CHUNK}"))))
    first = F.col("_part") * chunk
    return (r.withColumn("copy", F.explode(F.sequence(first + 1, F.least(first + chunk, F.col("_copies")))))
             .select(*TRAINING_COLUMNS, F.col("copy").cast("int").alias("copy")))


def stratified_split(df: DataFrame, label: str = "demand_level", train_fraction: float = SPLIT_TRAIN_FRACTION
                     ) -> DataFrame:
    """M6: per class, the first floor(f * n) rows in md5 order are 'train'."""
    counts = F.broadcast(df.groupBy(label).agg(F.count("*").alias("_n")))
    r = class_rank(df, label).join(counts, label)
    return (r.withColumn("split", F.when(F.col("r") <= F.floor(F.col("_n") * train_fraction), F.lit("train"))
                                   .otherwise(F.lit("test")))
             .drop("r", "_n"))


def label_codes(df: DataFrame, col: str, unknown: str | None = None) -> DataFrame:
    """Sorted-order codes 0..k-1 of the distinct values of ``col``: one row per value, (value, code)."""
    value = F.coalesce(F.col(col), F.lit(unknown)) if unknown else F.col(col)
    names = df.select(value.alias("value")).where(F.col("value").isNotNull()).distinct()
    return names.withColumn("code", (F.row_number().over(Window.orderBy("value")) - 1).cast("int"))


def apply_label_codes(df: DataFrame, codes: DataFrame, col: str, out: str, key: str = "asin", unknown: str | None = None) -> DataFrame:
    """Add the codes; a value without one gets 0."""
    value = F.coalesce(F.col(col), F.lit(unknown)) if unknown else F.col(col)
    share = F.pmod(F.xxhash64(key), F.lit(JOIN_SHARES)).cast("int")
    named = codes.select(F.col("value").alias("_value"), F.col("code").alias(out),
                         F.explode(F.sequence(F.lit(0), F.lit(JOIN_SHARES - 1))).alias("_s"))
    j = df.join(named, (value == F.col("_value")) & (share == F.col("_s")), "left").drop("_value", "_s")
    return j.withColumn(out, F.coalesce(out, F.lit(0)))


def encoded(scored: DataFrame) -> DataFrame:
    """M7 on all columns: cat_enc (null category -> 'Unknown') and label, alphabetical codes."""
    t = apply_label_codes(scored, label_codes(scored, CAT, "Unknown"), CAT, "cat_enc", unknown="Unknown")
    return apply_label_codes(t, label_codes(scored, "demand_level"), "demand_level", "label")


def label_encode(scored: DataFrame) -> DataFrame:
    """M7: category code (null -> 'Unknown') and level code, alphabetical."""
    return encoded(scored).select("asin", CAT, "cat_enc", "demand_level", "label")


FEATURES = ["stars_norm", "bought_norm", "bs_norm", "price_norm", "cat_enc"]


def standardize(df: DataFrame, features=tuple(FEATURES), fit_on: str = "train") -> DataFrame:
    """M8: z = (x - mean) / population std, fitted on the ``split == fit_on`` rows.

    The statistics are one aggregate row broadcast to every task.  (Spark ML's
    StandardScaler uses the sample std; the reference's scaler the population one.)
    """
    fit = df.where(F.col("split") == fit_on) if "split" in df.columns else df
    st = fit.agg(*[F.avg(f).alias(f"_m_{f}") for f in features],
                 *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    j = with_row(df, st)
    zs = [F.when(F.col(f"_s_{f}") > 0, (F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}"))
           .otherwise(F.lit(0.0)).alias(f"z_{f}") for f in features]
    keep = [c for c in df.columns if c not in features]
    return j.select(*keep, *zs)


def model_frame(scored: DataFrame) -> DataFrame:
    """Features + label + split for the demand classifier (M6 + M7)."""
    return stratified_split(encoded(scored).select("asin", "demand_level", *FEATURES, "label"))

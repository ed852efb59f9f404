"""Demand features, scores, levels and labels as column expressions.

Every function returns a ``Column`` built from built-in functions, so it stays
inside whole-stage codegen.  Computed doubles are rounded with ``round_half``
(binary value, half up); exact DECIMAL means use ``round``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results.
LEVEL_HIGH = 60.0                 # score >= 60 -> "High"
LEVEL_MEDIUM = 35.0               # score >= 35 -> "Medium", else "Low"
LEVELS = ("High", "Medium", "Low")
TREND_CUTS = (60.0, 50.0, 35.0)   # Surging / Rising / Stable / Declining
TREND_CUTS_LEGACY = (150.0, 130.0, 110.0)
TREND_NAMES = ("Surging", "Rising", "Stable", "Declining")
SEGMENTS = ("Hot", "Warm", "Cold")
CONFIDENCE_CAP = 95.0
REORDER_SCORE = 35.0              # reorder alert: score < 35 and bought < 100
REORDER_BOUGHT = 100
BESTSELLER_STARS = 4.5            # synthesized isBestSeller = stars > 4.5
FEATURE_WEIGHT = 0.25             # each of the four normalized features
QUICK_STARS_WEIGHT = 0.25         # listing quick score: stars * 0.25 * 25
QUICK_STARS_SCALE = 25.0
QUICK_BOUGHT_DIVISOR = 10.0       #   + min(bought / 10, 25)
QUICK_CAP = 25.0                  #   + 25 for a bestseller
PANEL_STARS_WEIGHT = 30.0         # seller panel: stars / 5 * 30
PANEL_BOUGHT_SCALE = 1000.0       #   + min(bought / 1000, 1) * 40
PANEL_BOUGHT_WEIGHT = 40.0
PANEL_BASE = 10.0                 #   + 10
LEGACY_STARS_WEIGHT = 20.0        # diagnostic score: stars * 20 + bought * 0.1
LEGACY_BOUGHT_WEIGHT = 0.1
RECOMMEND_SCORE_WEIGHT = 0.7      # trend recommendation: avg * 0.7 + units * 0.0003
RECOMMEND_UNITS_WEIGHT = 0.0003


def round_half(c, digits: int = 0) -> Column:
    """Round a double half up on its scaled binary value: floor(x*10^d + 0.5) / 10^d.

    Spark's ``round`` rounds the shortest decimal string of the double
    (32.925 -> 32.93), while the reference (pandas/numpy: rint(x*10^d)/10^d)
    and DuckDB round the scaled binary value (32.925*100 = 3292.4999.. ->
    32.92).  This form agrees with numpy except on exact .5 products (half up
    instead of half even) and is built from IEEE steps every engine evaluates
    identically.
    """
    m = float(10 ** digits)
    return F.floor(col_(c) * m + 0.5) / m


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col_(c)))


def stars_norm(stars="stars") -> Column:
    return ((col_(stars) - 1.0) / 4.0) * 100.0


def bought_norm(bought="boughtInLastMonth", bought_max="bought_max") -> Column:
    # 0 when the catalog has no sales at all (no division by zero).
    return F.when(col_(bought_max) > 0,
                  (col_(bought) / col_(bought_max)) * 100.0).otherwise(F.lit(0.0))


def bs_norm(bs="isBestSeller") -> Column:
    return F.when(col_(bs), F.lit(100.0)).otherwise(F.lit(0.0))


def price_norm(price="price", pmin="price_min", pmax="price_max") -> Column:
    # Inverse min-max: cheaper is higher; 50 when all prices are equal.
    return F.when(col_(pmax) > col_(pmin),
                  (1.0 - (col_(price) - col_(pmin)) / (col_(pmax) - col_(pmin))) * 100.0
                  ).otherwise(F.lit(50.0))


def composite(sn, bn, bsn, pn) -> Column:
    """Equal-weight composite of the four normalized features (unrounded)."""
    w = FEATURE_WEIGHT
    return col_(sn) * w + col_(bn) * w + col_(bsn) * w + col_(pn) * w


def demand_score(sn, bn, bsn, pn) -> Column:
    return round_half(composite(sn, bn, bsn, pn), 2)


def demand_level(score="demand_score") -> Column:
    s = col_(score)
    return (F.when(s >= LEVEL_HIGH, F.lit("High"))
             .when(s >= LEVEL_MEDIUM, F.lit("Medium"))
             .otherwise(F.lit("Low")))


def trend_label(score, cuts=TREND_CUTS) -> Column:
    s = col_(score)
    return (F.when(s >= cuts[0], F.lit(TREND_NAMES[0]))
             .when(s >= cuts[1], F.lit(TREND_NAMES[1]))
             .when(s >= cuts[2], F.lit(TREND_NAMES[2]))
             .otherwise(F.lit(TREND_NAMES[3])))


def confidence(score="demand_score", divisor: float = 100.0, floor_zero: bool = False) -> Column:
    c = F.least(F.lit(CONFIDENCE_CAP), (col_(score) / divisor) * 95.0)
    if floor_zero:
        c = F.greatest(F.lit(0.0), c)
    return round_half(c, 1)


def clipped_features(stars="stars", bought="boughtInLastMonth", bs="isBestSeller", price="price") -> dict[str, Column]:
    """The four features of one listing against catalog stats, each clipped to [0, 100].

    Needs columns bought_max, price_min, price_max (the one stats row).
    """
    spread = F.col("price_max") - F.col("price_min")
    return {"stars_norm": clip(stars_norm(stars)),
            "bought_norm": F.when(F.col("bought_max") > 0, clip((col_(bought) / F.col("bought_max")) * 100.0)).otherwise(F.lit(0.0)),
            "bs_norm": bs_norm(bs),
            "price_norm": F.when(F.col("price_max") > F.col("price_min"), clip((1.0 - (col_(price) - F.col("price_min")) / spread) * 100.0)
                                 ).otherwise(F.lit(50.0))}


def clipped_score(stars, bought, bs, price) -> Column:
    """Score of one listing: the clipped mean of its ``clipped_features``."""
    f = clipped_features(stars, bought, bs, price)
    return round_half(clip((f["stars_norm"] + f["bought_norm"] + f["bs_norm"] + f["price_norm"]) * FEATURE_WEIGHT), 2)


def quick_score(stars="stars", bought="boughtInLastMonth", bs="isBestSeller") -> Column:
    """Listing score used by the product list and lookup (no price term)."""
    return round_half(col_(stars) * QUICK_STARS_WEIGHT * QUICK_STARS_SCALE
                      + F.least(col_(bought) / QUICK_BOUGHT_DIVISOR, F.lit(QUICK_CAP))
                      + F.when(col_(bs), F.lit(QUICK_CAP)).otherwise(F.lit(0.0)), 2)


def seller_panel_score(stars_num, bought_int) -> Column:
    """Seller page score: round(stars/5*30 + min(bought/1000,1)*40 + 10).

    Rounds like the browser's Math.round (floor(x + 0.5)).
    """
    x = ((col_(stars_num) / 5.0) * PANEL_STARS_WEIGHT
         + F.least(col_(bought_int) / PANEL_BOUGHT_SCALE, F.lit(1.0)) * PANEL_BOUGHT_WEIGHT + PANEL_BASE)
    return F.floor(x + 0.5)


def legacy_score(stars="stars", bought="boughtInLastMonth") -> Column:
    return col_(stars) * LEGACY_STARS_WEIGHT + col_(bought) * LEGACY_BOUGHT_WEIGHT


_EXACT = "decimal(38,12)"          # of a value in a sum: any double to 12 decimals, sums below 10^26
_FAR = 1e15                       # a value from here on is added as a double: it has no decimals left


def exact_total(c) -> Column:
    """Sum of a column as a decimal of 12 places, exact and independent of how partitions are merged.

    Values of ``_FAR`` and more are added apart; a total beyond the decimal is null, never an error.
    """
    x = col_(c).cast("double")
    near = F.sum(F.when(F.abs(x) >= _FAR, F.lit(0).cast(_EXACT)).otherwise(x.cast(_EXACT)))
    return near + F.coalesce(F.sum(F.when(F.abs(x) >= _FAR, x)), F.lit(0.0)).try_cast(_EXACT)


def exact_mean(c) -> Column:
    """Mean of a column as a decimal of 12 places; only the one value per group is divided."""
    return exact_total(c) / F.nullif(F.count(col_(c)), F.lit(0)).cast("decimal(20,0)")


def exact_avg(c, digits: int = 2) -> Column:
    """``exact_mean`` rounded half up to ``digits`` places, as a double."""
    return F.round(exact_mean(c), digits).cast("double")


def exact_sum(c) -> Column:
    """``exact_total`` as a double."""
    return exact_total(c).cast("double")

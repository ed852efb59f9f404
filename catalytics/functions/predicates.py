"""Search, filter and validation predicates as column expressions.

Null handling follows the reference's pandas behaviour: a null title never
matches a search, and group keys are filtered non-null before grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalytics.functions.scores import REORDER_BOUGHT, REORDER_SCORE, col_

# The title filter of the raw-feed cleaner.
EXCLUDED_TITLE_PATTERN = r"(?i)\bbra\b"


def search_regex(pattern: str, title="title") -> Column:
    """Case-insensitive regular-expression search anywhere in the title."""
    return F.coalesce(col_(title).rlike("(?i)" + pattern), F.lit(False))


def search_literal(text: str, title="title") -> Column:
    """Case-insensitive literal substring search (listings)."""
    return F.coalesce(F.lower(col_(title)).contains(text.lower()), F.lit(False))


def catalog_filter(search: str | None = None, category: str | None = None,
                   min_price: float | None = None, max_price: float | None = None,
                   min_stars: float | None = None, bestseller: bool | None = None,
                   literal: bool = False) -> Column:
    """Compose the optional product-list filters into one predicate.

    Catalyst pushes the comparisons on scan columns down to Parquet.
    """
    cond = F.lit(True)
    if search:
        cond = cond & (search_literal(search) if literal else search_regex(search))
    if category:
        cond = cond & F.coalesce(F.col("categoryName") == category, F.lit(False))
    if min_price is not None:
        cond = cond & (F.col("price") >= float(min_price))
    if max_price is not None:
        cond = cond & (F.col("price") <= float(max_price))
    if min_stars is not None:
        cond = cond & (F.col("stars") >= float(min_stars))
    if bestseller is not None:
        cond = cond & (F.col("isBestSeller") == bool(bestseller))
    return cond


def reorder_predicate(score="demand_score", bought="boughtInLastMonth") -> Column:
    return (col_(score) < REORDER_SCORE) & (col_(bought) < REORDER_BOUGHT)


def excluded_terms(df: DataFrame, title="title", key_cols=("asin", "title", "categoryName")) -> DataFrame:
    """Drop rows with a missing key column, then titles matching the excluded word."""
    return (df.dropna(subset=list(key_cols))
              .where(~F.coalesce(F.col(title).rlike(EXCLUDED_TITLE_PATTERN), F.lit(False))))


def request_reason(price="price", stars="stars", bought="boughtInLastMonth") -> Column:
    """First failed rule of a prediction request, or null; an empty category is accepted and encodes to 0."""
    return (F.when(col_(price).isNull() | (col_(price) <= 0), F.lit("price must be > 0"))
             .when(col_(stars).isNull() | (col_(stars) < 1.0) | (col_(stars) > 5.0), F.lit("stars must be between 1 and 5"))
             .when(col_(bought) < 0, F.lit("boughtInLastMonth must be >= 0")))


def edit_is_valid(price="price", stars="stars", bought="boughtInLastMonth", title="title", category="categoryName") -> Column:
    """True for an edit whose supplied fields (null: not supplied) pass the listing rules."""
    fields = [col_(price) <= 0, (col_(stars) < 1.0) | (col_(stars) > 5.0), col_(bought) < 0, F.trim(col_(title)) == "", F.trim(col_(category)) == ""]
    bad = F.lit(False)
    for f in fields:
        bad = bad | F.coalesce(f, F.lit(False))
    return ~bad


def reject_reason(price="price", stars="stars", bought="boughtInLastMonth",
                  title="title", category="categoryName") -> Column:
    """First failed validation rule of a listing, or null when it is valid."""
    blank = lambda c: col_(c).isNull() | (F.trim(col_(c)) == "")
    return (F.when(blank(title), F.lit("title required"))
             .when(blank(category), F.lit("category required"))
             .when(col_(price).isNull() | (col_(price) <= 0), F.lit("price must be > 0"))
             .when(col_(stars).isNull() | (col_(stars) < 1.0) | (col_(stars) > 5.0),
                   F.lit("stars must be between 1 and 5"))
             .when(col_(bought) < 0, F.lit("boughtInLastMonth must be >= 0")))


def parse_bool(c) -> Column:
    """'TRUE'/'true' -> true, anything else (also null) -> false."""
    return F.coalesce(F.upper(F.trim(col_(c))) == "TRUE", F.lit(False))


def js_parse_float(c) -> Column:
    """Leading numeric prefix like the browser's parseFloat; unparsable -> 0."""
    num = F.regexp_extract(col_(c), r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1)
    return F.coalesce(num.try_cast("double"), F.lit(0.0))


def js_parse_int(c) -> Column:
    """Leading integer prefix like the browser's parseInt; unparsable -> 0."""
    num = F.regexp_extract(col_(c), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(num.try_cast("bigint"), F.lit(0).cast("bigint"))

"""Attach one-row results (global statistics, counts) to every row.

A one-row aggregate becomes a scalar subquery: Spark runs it once before the
main query and substitutes the value, so there is no join at all, and a
result with more than one row fails the query instead of multiplying rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` plus the columns of the single row of ``row``."""
    r = row.select(F.struct(*[F.col(f"`{c}`") for c in row.columns]).alias("_row")).scalar()
    return df.select("*", *[r[c].alias(c) for c in row.columns])


JOIN_SHARES = 32


def join_by_share(rows: DataFrame, small: DataFrame, key: str, row_id: str, shares: int = JOIN_SHARES) -> DataFrame:
    """Inner join of many rows to one-row-per-key values, with each key's rows dealt over ``shares`` tasks.

    A key that holds a third of the rows would otherwise meet its one partner in one task.  The
    small side is repeated per share; the rows are shuffled by (key, share) at most.
    """
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64(row_id), F.lit(shares)).cast("int"))
    copies = small.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return dealt.join(copies, [key, "_share"]).drop("_share")

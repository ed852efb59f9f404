"""Stored tables that jobs change or read in part (U1-U3, U7, T1): merges into touched partitions, a page directory.

A listing store is a Parquet table partitioned by a hash of the listing id.  A merge reads and
rewrites only the buckets that the change log names (dynamic partition overwrite); the files of all
other buckets keep their names.  Deleted rows stay as marked rows, so a bucket never vanishes half
way, and a merge that runs again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalytics.session import scratch_path

BUCKETS = 64
_MARK = "_deleted"


def bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(buckets)).cast("int")


def write_store(rows: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> None:
    """Store rows by bucket of their key, one file each."""
    out = rows.withColumn(_MARK, F.lit(False)).withColumn("bucket", bucket(key, buckets))
    out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)



def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(~F.col(_MARK)).drop(_MARK, "bucket")


def touched_buckets(changes: DataFrame, key: str, buckets: int) -> list[int]:
    """Numbers of the buckets that a change log names: at most ``buckets``."""
    return sorted(r[0] for r in changes.select(bucket(key, buckets)).distinct().collect() if r[0] is not None)


def merge(spark: SparkSession, path: str, changes: DataFrame, job: Callable[[DataFrame, DataFrame], DataFrame], key: str = "id",
          buckets: int = BUCKETS) -> list[int]:
    """Apply ``job(rows, changes)`` to the touched buckets and write them back; the touched buckets.

    ``job`` gives the rows as they shall be; a row that it leaves out is marked as deleted.  New
    keys may come in.  The new rows are written aside first: they are made of the files that they replace.
    """
    touched = touched_buckets(changes, key, buckets)
    if not touched:
        return []
    held = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    live = held.where(~F.col(_MARK)).drop(_MARK, "bucket")
    new = job(live, changes).select(*live.columns).withColumn(_MARK, F.lit(False)).withColumn("bucket", bucket(key, buckets))
    gone = held.join(new.select(key), key, "left_anti").withColumn(_MARK, F.lit(True)).select(*new.columns)
    aside = scratch_path(spark, "merge")
    new.unionByName(gone).repartition("bucket").write.parquet(aside)
    spark.read.schema(new.schema).parquet(aside).repartition("bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


# ---------------------------------------------------------------- page directory
def write_pages(rows: DataFrame, order: list, path: str, ranges: int | None = None) -> None:
    """Store rows in their list order: ranges of about equal size (by default as many as shuffle
    partitions), each sorted and numbered from 1 (``_place``)."""
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    aside, ranged = scratch_path(spark, "pages"), rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(aside)                           # written once, so that the sampled ranges stay as they are
    ranged = spark.read.schema(ranged.schema).parquet(aside)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranged.withColumn("_place", place).repartition("_range").write.partitionBy("_range").parquet(path)


def directory(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(range, rows before it, its rows) of every range, in order; counts come from the files' footers."""
    sizes = {r["_range"]: r["n"] for r in spark.read.parquet(path).groupBy("_range").agg(F.count("*").alias("n")).collect()}
    out, before = [], 0
    for r in sorted(sizes):
        out.append((r, before, sizes[r]))
        before += sizes[r]
    return out


def page_ranges(entries: list[tuple[int, int, int]], page: int, limit: int) -> list[tuple[int, int]]:
    """(range, rows before it) of the ranges that hold a page."""
    first, last = (page - 1) * limit + 1, page * limit
    return [(r, before) for r, before, n in entries if before < last and before + n >= first]


def read_page(spark: SparkSession, path: str, entries: list[tuple[int, int, int]], page: int, limit: int) -> DataFrame:
    """One page, however deep: only its ranges are read, and of them only its places."""
    rows, first, last = spark.read.parquet(path), (page - 1) * limit + 1, page * limit
    wanted = F.lit(False)
    at = F.lit(None).cast("bigint")
    for r, before in page_ranges(entries, page, limit):
        wanted = wanted | ((F.col("_range") == r) & F.col("_place").between(first - before, last - before))
        at = F.when(F.col("_range") == r, F.col("_place") + before).otherwise(at)
    return rows.where(wanted).withColumn("_at", at).orderBy("_at").drop("_at", "_place", "_range")

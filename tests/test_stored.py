"""Stored tables: merges rewrite touched buckets only, pages read few ranges, the quarantine loses no record, sketches keep their bound."""

import glob

import pytest
from pyspark.sql import functions as F

from catalytics.operators import sketches as SK
from catalytics.sources import quarantine as Q
from catalytics.sources import stored as SD
from helpers import rows

ROW = "id long, owner_email string, price double"


def files(path):
    return {f for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def job(live, changes):
    """Rows of the changes replace, a null price deletes, new ids come in."""
    new = changes.select(*live.columns).where("price is not null")
    return live.join(changes.select("id"), "id", "left_anti").select(*live.columns).unionByName(new)


def test_a_merge_rewrites_touched_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/store"
    start = {i: (f"o{i % 5}", float(i)) for i in range(400)}
    SD.write_store(spark.createDataFrame([(i, *v) for i, v in start.items()], ROW), path, buckets=16)
    before = files(path)
    log = [(3, "o3", 99.0), (7, "o2", None), (1000, "new", 5.0)]
    changes = spark.createDataFrame(log, ROW)
    touched = SD.merge(spark, path, changes, job, buckets=16)
    assert touched == SD.touched_buckets(changes, "id", 16) and 1 <= len(touched) <= 3
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept and kept <= files(path) and not (before - kept) & files(path)
    want = {**start, 3: ("o3", 99.0), 1000: ("new", 5.0)}
    del want[7]
    got = {r["id"]: (r["owner_email"], r["price"]) for r in rows(SD.read_store(spark, path))}
    assert got == want
    SD.merge(spark, path, changes, job, buckets=16)                # the same log again changes nothing
    assert {r["id"]: (r["owner_email"], r["price"]) for r in rows(SD.read_store(spark, path))} == want
    SD.merge(spark, path, spark.createDataFrame([(7, "o7", 1.0)], ROW), job, buckets=16)     # a deleted id comes back
    assert SD.read_store(spark, path).where("id = 7").count() == 1
    assert SD.merge(spark, path, changes.limit(0), job, buckets=16) == []


def test_a_bucket_that_loses_all_rows_is_empty(spark, tmp_path):
    path = f"{tmp_path}/store"
    SD.write_store(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], ROW), path, buckets=1)
    SD.merge(spark, path, spark.createDataFrame([(1, "a", None), (2, "b", None)], ROW), job, buckets=1)
    assert rows(SD.read_store(spark, path)) == []


@pytest.mark.parametrize("limit", [1, 7, 50, 1000])
def test_pages_equal_offsets_and_read_few_ranges(spark, tmp_path, limit):
    path, order = f"{tmp_path}/pages", [F.col("v").desc_nulls_last(), F.col("id").asc()]
    df = spark.range(333).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("v"))
    SD.write_pages(df, order, path)
    entries, whole = SD.directory(spark, path), [tuple(r.values()) for r in rows(df.orderBy(*order))]
    assert sum(n for *_, n in entries) == 333 and len(entries) > 2
    smallest = min(n for *_, n in entries)
    for page in {1, 2, 333 // limit // 2 + 1, 333 // limit + 1, 333 // limit + 2}:
        got = [tuple(r.values()) for r in rows(SD.read_page(spark, path, entries, page, limit))]
        assert got == whole[(page - 1) * limit:page * limit]
        assert len(SD.page_ranges(entries, page, limit)) <= limit // smallest + 2


def test_accepted_and_rejected_are_all_records(spark, tmp_path):
    lines = ["1,10,a@x,5.5", "x,11,b@x,1", "3,,c@x,2", "4,13", "5,14,d@x,many", "6,15,e@x,", "7,16,f@x,1,extra", '8,17,"g, h",2']
    with open(f"{tmp_path}/in.csv", "w") as f:
        f.write("\n".join(["asin,id,owner_email,price", *lines]) + "\n")
    columns, types = ["asin", "id", "owner_email", "price"], {"asin": "bigint", "id": "bigint", "price": "double"}
    Q.load(spark, f"{tmp_path}/in.csv", f"{tmp_path}/good", f"{tmp_path}/bad", columns, types, ("id",))
    good, bad = rows(spark.read.parquet(f"{tmp_path}/good")), rows(spark.read.json(f"{tmp_path}/bad"))
    assert len(good) + len(bad) == len(lines)
    assert {r["asin"]: r["price"] for r in good} == {1: 5.5, 6: None, 8: 2.0}
    reasons = sorted(r["reject_reason"] for r in bad)
    assert reasons == ["asin is no bigint", "id required", "price is no double", Q.WRONG_COLUMNS, Q.WRONG_COLUMNS]
    assert {r["record"] for r in bad if r["reject_reason"] == Q.WRONG_COLUMNS} == {"4,13", "7,16,f@x,1,extra"}


def test_merged_sketches_keep_their_rank_error(spark):
    data = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("b").alias("k"), (F.col("id") % 40).alias("day"),
                                      (F.xxhash64("id") % 100_000).cast("double").alias("v"))
    stored = SK.period_sketches(data, "k", F.col("day"), "v")
    assert stored.count() == 80
    part = data.where("day between 5 and 31")
    got = SK.merged_quantiles(stored, "k", 5, 31)
    errors = rows(SK.rank_errors(part, got, "k", "v"))
    exact = {r["k"]: r["count"] for r in rows(part.groupBy("k").count())}
    assert {r["k"]: r["n"] for r in errors} == exact and all(r["worst"] <= SK.RANK_ERROR for r in errors)
    few = spark.createDataFrame([("a", 1, float(x)) for x in range(101)], "k string, day int, v double")
    assert rows(SK.merged_quantiles(SK.period_sketches(few, "k", F.col("day"), "v"), "k", 1, 1))[0]["q"] == [25.0, 50.0, 75.0]

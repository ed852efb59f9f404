"""Readers and writers: CSV/JSON/Parquet round trips, fallback, raw feeds, images."""

import os
import tempfile

import pytest

from pyspark.sql import functions as F

from catalytics.sources import readers as RD
from catalytics.plans.queries import catalog, catalog_documents, listings
from helpers import SF_SMALL, rows


def test_catalog_csv_round_trip(spark):
    c = catalog(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="cat-")
    RD.write_table(c, path, fmt="csv")
    back = RD.read_catalog(spark, path, fmt="csv")
    assert back.schema == RD.CATALOG_SCHEMA
    assert back.exceptAll(c.select(*[f.name for f in RD.CATALOG_SCHEMA.fields])).count() == 0


def test_documents_json(spark):
    path = tempfile.mkdtemp(prefix="docs-")
    catalog_documents(spark, SF_SMALL).write.mode("overwrite").json(path)
    d = RD.read_catalog_documents(spark, path)
    assert "_id" not in d.columns
    assert dict(d.dtypes)["boughtInLastMonth"] == "int" and dict(d.dtypes)["price"] == "double"


def test_fallback_only_when_empty(spark):
    c = catalog(spark, SF_SMALL)
    assert RD.with_fallback(c.where(F.col("asin") < 0), c).count() == c.count()
    assert RD.with_fallback(c.limit(3), c).count() == 3


def test_fallback_is_decided_when_the_query_runs(spark):
    """A fallback that fails when it is read is not read while the primary source has rows."""
    c = spark.range(5).toDF("asin")
    broken = spark.range(5).select(F.raise_error(F.lit("the fallback was read")).cast("long").alias("asin"))
    assert RD.with_fallback(c, broken).count() == 5
    with pytest.raises(Exception, match="the fallback was read"):
        RD.with_fallback(c.where("asin < 0"), broken).collect()


def test_stored_dataset_information_names_the_stored_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "High"), (2, "Low"), (3, "Low")], "asin long, demand_level string")
    for fmt in ("csv", "parquet"):
        RD.write_table(df, f"{tmp_path}/{fmt}", fmt=fmt)
        got = rows(RD.stored_dataset_info(spark, f"{tmp_path}/{fmt}", fmt))
        assert {(r["demand_level"], r["count"], r["total_rows"], r["n_columns"], r["columns"]) for r in got} == {
            ("High", 1, 3, 2, "asin, demand_level"), ("Low", 2, 3, 2, "asin, demand_level")}


def test_raw_feed_column_variants(spark):
    a = spark.createDataFrame([("1", "Shirt", "Apparel")], "id string, `display name` string, category string")
    b = spark.createDataFrame([("7.jpg", "Cap", "Accessories")],
                              "image string, productDisplayName string, masterCategory string")
    assert rows(RD.normalize_raw_feed(a))[0] == {"asin": "1", "title": "Shirt", "categoryName": "Apparel"}
    assert rows(RD.normalize_raw_feed(b))[0] == {"asin": "7", "title": "Cap", "categoryName": "Accessories"}


def test_synthesized_fields_ranges(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("asin"))
    s = rows(RD.synthesize_fields(df).agg(F.min("price"), F.max("price"), F.min("stars"), F.max("stars"),
                                          F.min("boughtInLastMonth"), F.max("boughtInLastMonth"),
                                          F.sum(F.col("isBestSeller").cast("int")).alias("bs"),
                                          F.count_if(F.col("stars") > 4.5).alias("hi")))[0]
    assert 500 <= s["min(price)"] and s["max(price)"] <= 5000
    assert 3.5 <= s["min(stars)"] and s["max(stars)"] <= 5.0
    assert 50 <= s["min(boughtInLastMonth)"] and s["max(boughtInLastMonth)"] <= 999
    assert s["bs"] == s["hi"]


def test_binary_assets(spark):
    d = tempfile.mkdtemp(prefix="img-")
    for name in ("11.jpg", "12.jpg", "notes.txt"):
        with open(os.path.join(d, name), "wb") as f:
            f.write(b"\xff\xd8\xff" + name.encode())
    a = rows(RD.read_assets(spark, d))
    assert sorted(r["asin"] for r in a) == [11, 12]


def test_json_export_and_counts(spark):
    j = rows(RD.csv_records_as_json(listings(spark, SF_SMALL)).limit(1))[0]["json"]
    assert j.startswith('{"asin":"') and '"isBestSeller":"' in j
    counts = rows(RD.collection_counts({"a": spark.range(3), "b": spark.range(0)}))
    assert {r["collection"]: r["rows"] for r in counts} == {"a": 3, "b": 0}

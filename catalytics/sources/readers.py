"""Typed readers and writers for the catalog's file formats.

Explicit schemas (no inference), so a scan of a 100 TB folder never reads the
data twice and column pruning/pushdown apply.  CSV, JSON and Parquet go
through ``spark.read``; images through the ``binaryFile`` source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalytics.functions.scalars import with_row
from pyspark.sql import types as T

CAT = "categoryName"

CATALOG_SCHEMA = T.StructType([
    T.StructField("asin", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField(CAT, T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("boughtInLastMonth", T.LongType()),
    T.StructField("stars", T.DoubleType()),
    T.StructField("isBestSeller", T.BooleanType()),
])

# The columns of the seller, user and document sources, and the numeric fields of documents.
LISTING_FIELDS = ["asin", "id", "owner_email", "title", CAT, "price", "stars", "boughtInLastMonth",
                  "isBestSeller", "description", "image_filename", "added_on"]
LISTING_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in LISTING_FIELDS])
USER_FIELDS = ["email", "password_hash", "name", "phone", "department", "city", "role", "joined"]
USER_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in USER_FIELDS])


def read_catalog(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Typed product scan (CSV with header, or Parquet).

    CSV columns are matched by header name, not position (as a dtype map
    does), each read as a string and cast; an unparsable value becomes null.
    No inference pass over the data is made.
    """
    if fmt == "csv":
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
        return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in raw.columns
                            else F.lit(None).cast(f.dataType).alias(f.name) for f in CATALOG_SCHEMA.fields])
    return spark.read.schema(CATALOG_SCHEMA).parquet(path)


DOCUMENT_CASTS = {"asin": "bigint", "price": "double", "stars": "double", "boughtInLastMonth": "int"}


def documents_to_catalog(docs: DataFrame) -> DataFrame:
    """Documents of the product collection: drop ``_id``, cast the four
    numeric fields (the rest keep their stored types)."""
    d = docs.drop("_id")
    return d.select(*[F.col(c).try_cast(DOCUMENT_CASTS[c]).alias(c) if c in DOCUMENT_CASTS else F.col(c)
                      for c in d.columns])


# The fields of an exported product document; numbers are read as text and cast.
DOCUMENT_SCHEMA = T.StructType([T.StructField(c, T.BooleanType() if c == "isBestSeller" else T.StringType())
                                for c in ("_id", "asin", "title", CAT, "price", "stars", "boughtInLastMonth", "isBestSeller")])


def read_catalog_documents(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT_SCHEMA) -> DataFrame:
    """S2 from JSON-lines exports of the collection, read once: the schema is given, not inferred."""
    return documents_to_catalog(spark.read.schema(schema).json(path))


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """S3: the rows of ``fallback`` only where the primary source is empty.

    Building the plan reads nothing.  The check is a scalar subquery over one row of the primary
    source; where it finds one, the filter on the fallback is false before its scan starts.
    """
    empty = primary.limit(1).agg((F.count("*") == 0).alias("empty")).scalar()
    return primary.unionByName(fallback.select(*primary.columns).where(empty))


def read_listings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Seller listings CSV, every field as a string (parsed later with try_cast); an empty field is an empty string."""
    raw = spark.read.schema(LISTING_SCHEMA).option("header", True).csv(path)
    return raw.fillna("")


def read_users_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USER_SCHEMA).option("header", True).csv(path)


# Raw-feed column alternatives, first present wins.
TITLE_COLUMNS = ("display name", "productDisplayName")
CATEGORY_COLUMNS = ("category", "masterCategory")


def normalize_raw_feed(raw: DataFrame) -> DataFrame:
    """Canonical title/categoryName/asin from whichever raw columns exist.

    asin comes from ``id``, else from ``image`` without ``.jpg``.
    """
    cols = set(raw.columns)
    title = next((F.col(f"`{c}`") for c in TITLE_COLUMNS if c in cols), F.lit(None).cast("string"))
    cat = next((F.col(f"`{c}`") for c in CATEGORY_COLUMNS if c in cols), F.lit(None).cast("string"))
    if "id" in cols:
        asin = F.col("id").cast("string")
    elif "image" in cols:
        asin = F.replace(F.col("image").cast("string"), F.lit(".jpg"), F.lit(""))
    else:
        asin = F.lit(None).cast("string")
    return raw.select(asin.alias("asin"), title.alias("title"), cat.alias(CAT))


def synthesize_fields(df: DataFrame, seed: int = 42) -> DataFrame:
    """Reproducible price 500-5000 (2 dp), bought 50-999, stars 3.5-5.0
    (1 dp) from md5(asin, seed, field) as a uniform number in [0, 1);
    isBestSeller = stars > 4.5.  Per-row expressions only (no shuffle)."""
    from catalytics.functions.scores import round_half

    def u(tag: str):
        h = F.md5(F.concat(F.col("asin").cast("string"), F.lit(str(seed)), F.lit(tag)))
        return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / float(1 << 32)
    return (df.withColumn("price", round_half(500.0 + u("price") * 4500.0, 2))
              .withColumn("boughtInLastMonth", (50 + F.floor(u("bought") * 950.0)).cast("bigint"))
              .withColumn("stars", round_half(3.5 + u("stars") * 1.5, 1))
              .withColumn("isBestSeller", F.col("stars") > 4.5))


def dedup_first(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Keep the first row (lowest ``seq``) per key.

    ``min_by`` is a partial aggregate, so many copies of one key are reduced
    on the map side instead of being sorted in one task.
    """
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(seq)).alias("_r")).select(key, "_r.*")


def clean_users(raw: DataFrame) -> DataFrame:
    """Trim + lower email, role defaults to 'Analyst', blank emails dropped."""
    return (raw.withColumn("email", F.lower(F.trim("email")))
               .withColumn("role", F.coalesce(F.col("role"), F.lit("Analyst")))
               .where(F.col("email").isNotNull() & (F.col("email") != "")))


def read_assets(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """Image files as rows (path, length, content), asin from the file name."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return df.select("path", "length", "content",
                     F.regexp_extract("path", r"([^/]+)\.jpg$", 1).try_cast("bigint").alias("asin"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a result (CSV with header, JSON lines, plain lines of one string column, or Parquet)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "text":
        w.text(path)
    else:
        w.parquet(path)


def csv_records_as_json(df: DataFrame) -> DataFrame:
    """Every row as one JSON object of strings (the CSV -> JSON export)."""
    return df.select(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns]),
                               {"ignoreNullFields": "false"}).alias("json"))


def collection_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table as one union of global counts."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("collection"), "rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dataset_info(training: DataFrame) -> DataFrame:
    """Training set: rows per level, total rows, number and names of the columns."""
    sizes = training.groupBy("demand_level").agg(F.count("*").alias("count"))
    return (with_row(sizes, sizes.agg(F.sum("count").alias("total_rows")))
            .withColumn("n_columns", F.lit(len(training.columns)))
            .withColumn("columns", F.lit(", ".join(training.columns))))


def stored_dataset_info(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """S12 from what was written: the columns are those of the stored header or schema, the rows are counted from the level column alone."""
    stored = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)
    return dataset_info(stored)

"""Reading with a quarantine (S1, S4, P18): rows that cannot be used go to a second sink with the reason, none is lost.

The file is read once, as text columns with the raw line of records that do not fit the columns.
A record is rejected by the first rule it breaks; accepted and rejected together are all records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
WRONG_COLUMNS = "wrong number of columns"
# The types of the listing columns that are not text, and the columns that must not be blank.
LISTING_TYPES = {"asin": "bigint", "id": "bigint", "price": "double", "stars": "double", "boughtInLastMonth": "bigint"}
LISTING_REQUIRED = ("id",)


def read_checked(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """The named text columns of a CSV file, and the raw line of a record with other than that many fields."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])
    return spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)


def reason(types: dict[str, str], required: tuple[str, ...]) -> Column:
    """The first rule that a record breaks, else null.  An empty optional field is no error."""
    out = F.when(F.col(CORRUPT).isNotNull(), WRONG_COLUMNS)
    for c in required:
        out = out.when(F.coalesce(F.trim(c), F.lit("")) == "", f"{c} required")
    for c, kind in types.items():
        bad = (F.coalesce(F.trim(c), F.lit("")) != "") & F.col(c).try_cast(kind).isNull()
        out = out.when(bad, f"{c} is no {kind}")
    return out


def split_records(raw: DataFrame, types: dict[str, str], required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with their types, rejected rows with the reason and the record)."""
    columns = [c for c in raw.columns if c != CORRUPT]
    judged = raw.withColumn("reject_reason", reason(types, required))
    accepted = judged.where(F.col("reject_reason").isNull()).select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in columns])
    record = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*columns)))
    return accepted, judged.where(F.col("reject_reason").isNotNull()).select("reject_reason", record.alias("record"))


def load(spark: SparkSession, path: str, accepted_path: str, rejected_path: str, columns: list[str], types: dict[str, str],
         required: tuple[str, ...] = (), header: bool = True) -> None:
    """Write both sinks."""
    accepted, rejected = split_records(read_checked(spark, path, columns, header), types, required)
    accepted.write.mode("overwrite").parquet(accepted_path)
    rejected.write.mode("overwrite").json(rejected_path)

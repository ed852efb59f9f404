"""Structured Streaming jobs: order ingest (U6) and units per day (2.7).

The same transformation functions run on a static DataFrame (batch) and on a
stream, so a stream run with ``trigger(availableNow=True)`` can be checked
against the batch result.  Keyed state lives in the session's state store
(RocksDB by ``session.get_session``) and checkpoints go under the shared
``spark.checkpoint.dir``; a restarted query resumes from its offsets and state,
so a lost executor or driver restart neither loses nor duplicates orders.  Every
micro-batch writes a folder of its own, which a repeated batch overwrites.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalytics.functions.scores import round_half

PURCHASE_SCHEMA = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("asin", T.LongType()),
    T.StructField("units", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("user_email", T.StringType()),
    T.StructField("amount", T.DoubleType()),
])

# The fields of an order request and of its address.
ADDRESS_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "address", "city", "pin", "phone")])
ORDER_SCHEMA = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("user_email", T.StringType()),
    T.StructField("items", T.ArrayType(T.LongType())),
    T.StructField("subtotal", T.DoubleType()),
    T.StructField("shipping", T.DoubleType()),
    T.StructField("total", T.DoubleType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("delivery_speed", T.StringType()),
    T.StructField("address", ADDRESS_SCHEMA),
])
CREATED_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


# ---------------------------------------------------------------- U6: orders
def purchase_documents(purchases: DataFrame) -> DataFrame:
    """Order rows of single purchases: lower-case email, status, ISO created_at."""
    return purchases.select("order_id", F.lower(F.trim("user_email")).alias("user_email"), "asin", "units",
                            round_half("amount", 2).alias("total"), F.lit("confirmed").alias("status"),
                            "ts", F.date_format("ts", CREATED_FORMAT).alias("created_at"))


def order_documents(requests: DataFrame) -> DataFrame:
    """Order documents of order requests: items, amounts, payment, delivery and address as sent, lower-case
    email, status, ISO created_at."""
    return requests.select("order_id", F.lower(F.trim("user_email")).alias("user_email"), "items", "subtotal", "shipping", "total",
                           "payment_method", "delivery_speed", "address", F.lit("confirmed").alias("status"),
                           "ts", F.date_format("ts", CREATED_FORMAT).alias("created_at"))


def one_per_order(docs: DataFrame) -> DataFrame:
    """One document per order id, the earliest (by time, then by the other fields).

    A minimum of one struct: it combines before the shuffle, and on a stream it is keyed state.
    """
    rest = [c for c in docs.columns if c not in ("order_id", "ts")]
    first = F.min(F.struct("ts", *rest)).alias("d")
    return docs.groupBy("order_id").agg(first).select("order_id", "d.ts", *[F.col(f"d.{c}").alias(c) for c in rest])


def ingest_orders(purchases: DataFrame) -> DataFrame:
    """U6 over single purchases as a batch job."""
    return one_per_order(purchase_documents(purchases))


def ingest_order_requests(requests: DataFrame) -> DataFrame:
    """U6 over whole order requests as a batch job."""
    return one_per_order(order_documents(requests))


def _source(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None, schema: T.StructType = PURCHASE_SCHEMA) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(source_dir)


def _run(rows: DataFrame, sink_dir: str, checkpoint: str, available_now: bool, every: str, mode: str):
    """Write what the query gives out for each micro-batch to the batch's own folder."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_dir}/batch={number}")
    w = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)).start()


def _sink(spark: SparkSession, sink_dir: str, schema: T.StructType) -> DataFrame:
    """The sink's rows; empty before the first batch."""
    try:
        return spark.read.schema(schema).parquet(f"{sink_dir}/batch=*")
    except AnalysisException as absent:
        if "PATH_NOT_FOUND" not in str(absent):
            raise
        return spark.createDataFrame([], schema)


def _ingest(spark: SparkSession, schema: T.StructType, job, source_dir: str, sink_dir: str, checkpoint: str,
            available_now: bool, max_files_per_trigger: int | None):
    src = _source(spark, source_dir, max_files_per_trigger, schema)
    return _run(job(src), sink_dir, checkpoint, available_now, "30 seconds", "update")


def start_order_ingest(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                       available_now: bool = True, max_files_per_trigger: int | None = None):
    """U6 on a stream of single purchases, from Parquet files in ``source_dir`` into one folder per micro-batch.

    The state keeps the document of every order id, so a repetition is recognized however late
    it comes; a batch reads and writes the orders it touches, whatever the size of the sink.
    The sink gets a document when it is new, and again in the rare case that an earlier request
    of its order arrives later: ``read_orders`` takes the earliest, as the batch job does.
    """
    return _ingest(spark, PURCHASE_SCHEMA, ingest_orders, source_dir, sink_dir, checkpoint, available_now, max_files_per_trigger)


def start_order_documents(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                          available_now: bool = True, max_files_per_trigger: int | None = None):
    """U6 on a stream of whole order requests; see ``start_order_ingest``."""
    return _ingest(spark, ORDER_SCHEMA, ingest_order_requests, source_dir, sink_dir, checkpoint, available_now, max_files_per_trigger)


def read_orders(spark: SparkSession, sink_dir: str) -> DataFrame:
    return one_per_order(_sink(spark, sink_dir, ingest_orders(spark.createDataFrame([], PURCHASE_SCHEMA)).schema))


def read_order_documents(spark: SparkSession, sink_dir: str) -> DataFrame:
    return one_per_order(_sink(spark, sink_dir, ingest_order_requests(spark.createDataFrame([], ORDER_SCHEMA)).schema))


# ---------------------------------------------------------------- 2.7: units per day
CLOSE_AFTER = "2 days"         # a day closes when purchases this much younger than its end have come


def _windowed(purchases: DataFrame) -> DataFrame:
    return (purchases.groupBy(F.window("ts", "1 day").alias("w"), "asin")
              .agg(F.sum("units").alias("units"), F.count("*").alias("orders"))
              .select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "asin", "units", "orders"))


def units_per_day(purchases: DataFrame) -> DataFrame:
    """Units and orders per asin per day (tumbling 1-day windows)."""
    return _windowed(purchases)


def start_units_per_day(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                        available_now: bool = True, max_files_per_trigger: int | None = None):
    """2.7 on a stream: every micro-batch writes its partial sums per (day, asin).

    Sums add up, so a purchase that comes late counts for its own day: nothing is dropped and
    no state is kept.  ``read_units`` adds the partial sums.
    """
    src = _source(spark, source_dir, max_files_per_trigger)

    def write(batch: DataFrame, number: int) -> None:
        units_per_day(batch).write.mode("overwrite").parquet(f"{sink_dir}/batch={number}")
    w = src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()


def _units_schema(spark: SparkSession) -> T.StructType:
    return units_per_day(spark.createDataFrame([], PURCHASE_SCHEMA)).schema


def read_units(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Units per asin per day over all batches so far."""
    parts = _sink(spark, sink_dir, _units_schema(spark))
    return parts.groupBy("day", "asin").agg(F.sum("units").alias("units"), F.sum("orders").alias("orders"))


def start_closed_days(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, close_after: str = CLOSE_AFTER,
                      available_now: bool = True, max_files_per_trigger: int | None = None):
    """2.7 with event time: the sums of a day are held as state until the watermark passes its end, given out
    once and forgotten.  Purchases of a closed day are late: they change nothing here and are found by ``late_units``."""
    src = _source(spark, source_dir, max_files_per_trigger).withWatermark("ts", close_after)
    return _run(_windowed(src), sink_dir, checkpoint, available_now, "1 minute", "append")


def read_closed_days(spark: SparkSession, sink_dir: str) -> DataFrame:
    """day, asin, units, orders of the days closed so far, one row each."""
    return _sink(spark, sink_dir, _units_schema(spark))


def late_units(closed: DataFrame, all_units: DataFrame) -> DataFrame:
    """Side table of late purchases: what days hold beyond the sums with which they were closed.

    A day is closed for every asin when it is closed for one; an asin that sold nothing in time
    has no row in ``closed``.  Both inputs are sums per (day, asin), so no purchase is read again.
    """
    days = closed.select("day").distinct()
    rest = all_units.join(days, "day", "left_semi").join(
        closed.select("day", "asin", F.col("units").alias("_units"), F.col("orders").alias("_orders")), ["day", "asin"], "left")
    zero = F.lit(0).cast("bigint")
    return rest.select("day", "asin", (F.col("units") - F.coalesce("_units", zero)).alias("units"),
                       (F.col("orders") - F.coalesce("_orders", zero)).alias("orders")).where("orders > 0")


def reconciled_days(closed: DataFrame, late: DataFrame) -> DataFrame:
    """Closed days with their late purchases added: equal to the batch job over the closed days."""
    return closed.unionByName(late).groupBy("day", "asin").agg(F.sum("units").alias("units"), F.sum("orders").alias("orders"))


def with_streamed_units(catalog: DataFrame, units: DataFrame, since_day: str) -> DataFrame:
    """The catalog with boughtInLastMonth raised by the streamed units from ``since_day`` on."""
    sold = units.where(F.col("day") >= since_day).groupBy("asin").agg(F.sum("units").alias("_sold"))
    return catalog.join(sold, "asin", "left").withColumn(
        "boughtInLastMonth", F.col("boughtInLastMonth") + F.coalesce("_sold", F.lit(0).cast("bigint"))).drop("_sold")

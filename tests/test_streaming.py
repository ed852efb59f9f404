"""Streams (trigger availableNow over Parquet files) equal the batch jobs,
including duplicate and late rows."""

import datetime as dt
import tempfile

from catalytics.streaming import orders as ST
from helpers import SF_SMALL, rows

T0 = dt.datetime(2024, 1, 1, 10, 0)
FIRST = [
    (1, 7, 2, T0, "A@x.com", 10.0),
    (1, 7, 2, T0 + dt.timedelta(minutes=5), "A@x.com", 10.0),      # duplicate order id
    (2, 7, 1, T0 + dt.timedelta(hours=3), "b@x.com", 5.0),
]
SECOND = [
    (3, 8, 3, T0 + dt.timedelta(days=1, hours=1), "c@x.com", 7.5),
    (4, 7, 1, T0 + dt.timedelta(hours=1), "d@x.com", 1.0),          # late: earlier ts, later file
    (5, 9, 1, T0 + dt.timedelta(days=3), "e@x.com", 2.0),           # moves the watermark past day 2
]


def _write(spark, src):
    for part in (FIRST, SECOND):
        spark.createDataFrame(part, ST.PURCHASE_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    return spark.createDataFrame(FIRST + SECOND, ST.PURCHASE_SCHEMA)


def test_order_ingest_stream_equals_batch(spark):
    src, base = tempfile.mkdtemp(prefix="src-"), tempfile.mkdtemp(prefix="sink-")
    df = _write(spark, src)
    ST.start_order_ingest(spark, src, f"{base}/orders", f"{base}/ck", max_files_per_trigger=1).awaitTermination()
    got = {r["order_id"]: r for r in rows(ST.read_orders(spark, f"{base}/orders"))}
    batch = {r["order_id"]: r for r in rows(ST.ingest_orders(df))}
    assert sorted(got) == [1, 2, 3, 4, 5] and got == batch
    assert got[1]["ts"] == T0                                        # the earliest of the repeated rows


def test_order_repeated_much_later_is_recognized(spark):
    """The same order id comes again days later and after a restart: the sink keeps one row."""
    src, base = tempfile.mkdtemp(prefix="src-"), tempfile.mkdtemp(prefix="sink-")
    for part in ([FIRST[0]], [(1, 7, 2, T0 + dt.timedelta(days=9), "a@x.com", 10.0), FIRST[2]]):
        spark.createDataFrame(part, ST.PURCHASE_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        ST.start_order_ingest(spark, src, f"{base}/orders", f"{base}/ck").awaitTermination()
    assert sorted((r["order_id"], r["ts"]) for r in rows(ST.read_orders(spark, f"{base}/orders"))) == [(1, T0), (2, FIRST[2][3])]


def test_units_per_day_stream_equals_batch_with_late_rows(spark):
    src, base = tempfile.mkdtemp(prefix="src-"), tempfile.mkdtemp(prefix="sink-")
    df = _write(spark, src)
    ST.start_units_per_day(spark, src, f"{base}/units", f"{base}/ck", max_files_per_trigger=1).awaitTermination()
    late = spark.createDataFrame([(9, 7, 5, T0 + dt.timedelta(hours=2), "c@x.com", 1.0)], ST.PURCHASE_SCHEMA)
    late.coalesce(1).write.mode("append").parquet(src)
    ST.start_units_per_day(spark, src, f"{base}/units", f"{base}/ck").awaitTermination()
    key = lambda d: {(r["day"], r["asin"]): (r["units"], r["orders"]) for r in rows(d)}
    stream = key(ST.read_units(spark, f"{base}/units"))
    assert stream == key(ST.units_per_day(df.union(late)))
    assert stream["2024-01-01", 7] == (2 + 2 + 1 + 1 + 5, 5)          # the late purchase counts for its own day
    catalog = spark.createDataFrame([(7, 10), (8, 0), (1, 4)], "asin long, boughtInLastMonth long")
    fed = {r["asin"]: r["boughtInLastMonth"] for r in rows(ST.with_streamed_units(catalog, ST.read_units(spark, f"{base}/units"), "2024-01-01"))}
    assert fed == {7: 21, 8: 3, 1: 4}


def _order(order_id, at, email="A@x.com", pay="card"):
    return (order_id, at, email, [7, 9], 20.0, 50.0, 70.0, pay, "express", ("Ann", "1 Road", "Pune", "000001", "+91 1"))


def test_order_documents_are_whole_and_survive_repeats_and_a_restart(spark):
    src, base = tempfile.mkdtemp(prefix="src-"), tempfile.mkdtemp(prefix="sink-")
    early, late = T0, T0 + dt.timedelta(days=40)
    parts = ([_order(1, early), _order(1, early + dt.timedelta(minutes=1), pay="again"), _order(2, late)],
             [_order(1, late, pay="much later"), _order(2, early, " B@X.com "), _order(3, early)])
    for part in parts:
        spark.createDataFrame(part, ST.ORDER_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        ST.start_order_documents(spark, src, f"{base}/orders", f"{base}/ck").awaitTermination()
    got = {r["order_id"]: r for r in rows(ST.read_order_documents(spark, f"{base}/orders"))}
    assert got == {r["order_id"]: r for r in rows(ST.ingest_order_requests(spark.createDataFrame(parts[0] + parts[1], ST.ORDER_SCHEMA)))}
    assert got[1]["payment_method"] == "card" and got[2]["user_email"] == "b@x.com" and got[2]["created_at"] == "2024-01-01T10:00:00"
    assert got[3] == {"order_id": 3, "ts": early, "user_email": "a@x.com", "items": [7, 9], "subtotal": 20.0, "shipping": 50.0, "total": 70.0,
                      "payment_method": "card", "delivery_speed": "express", "status": "confirmed", "created_at": "2024-01-01T10:00:00",
                      "address": {"name": "Ann", "address": "1 Road", "city": "Pune", "pin": "000001", "phone": "+91 1"}}


def test_a_batch_writes_the_orders_it_touches(spark):
    """The second batch repeats an old order and brings a new one: only the new one is written."""
    src, base = tempfile.mkdtemp(prefix="src-"), tempfile.mkdtemp(prefix="sink-")
    for part in ([_order(i, T0) for i in range(50)], [_order(3, T0 + dt.timedelta(days=1)), _order(99, T0)]):
        spark.createDataFrame(part, ST.ORDER_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        ST.start_order_documents(spark, src, f"{base}/orders", f"{base}/ck").awaitTermination()
    batches = {r["batch"]: r["n"] for r in rows(spark.read.option("basePath", f"{base}/orders").parquet(f"{base}/orders/batch=*").groupBy("batch").count()
                                                .withColumnRenamed("count", "n"))}
    assert batches[0] == 50 and sum(batches.values()) <= 52           # update mode gives the touched order 3 out as it was
    assert ST.read_order_documents(spark, f"{base}/orders").count() == 51


def test_closed_days_come_once_and_late_purchases_are_reconciled(spark):
    src, base = tempfile.mkdtemp(prefix="src-"), tempfile.mkdtemp(prefix="sink-")
    day = dt.timedelta(days=1)
    first = [(1, 7, 2, T0, "a", 1.0), (2, 8, 1, T0 + day, "a", 1.0), (3, 7, 5, T0 + 4 * day, "a", 1.0)]
    second = [(4, 7, 3, T0 + dt.timedelta(hours=1), "a", 1.0), (5, 9, 1, T0, "a", 1.0), (6, 7, 1, T0 + 2 * day, "a", 1.0), (7, 7, 1, T0 + 9 * day, "a", 1.0)]
    for part in (first, second):
        spark.createDataFrame(part, ST.PURCHASE_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        ST.start_closed_days(spark, src, f"{base}/closed", f"{base}/ck").awaitTermination()
    key = lambda d: {(r["day"], r["asin"]): (r["units"], r["orders"]) for r in rows(d)}
    closed = ST.read_closed_days(spark, f"{base}/closed")
    assert closed.count() == len(key(closed)) == 4                    # one row a day and asin
    assert key(closed) == {("2024-01-01", 7): (2, 1), ("2024-01-02", 8): (1, 1), ("2024-01-03", 7): (1, 1), ("2024-01-05", 7): (5, 1)}
    everything = ST.units_per_day(spark.createDataFrame(first + second, ST.PURCHASE_SCHEMA))
    late = ST.late_units(closed, everything)
    assert key(late) == {("2024-01-01", 7): (3, 1), ("2024-01-01", 9): (1, 1)}
    shut = closed.select("day").distinct()
    assert key(ST.reconciled_days(closed, late)) == key(everything.join(shut, "day", "left_semi"))


def test_order_requests_are_put_together_once(spark):
    """The lines are read once for first and repeated requests, which hold what the orders hold."""
    from catalytics.sources import fixtures as X
    posted = X.order_requests(spark, SF_SMALL)
    plan = posted._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("l_extendedprice") and plan.count("FileScan parquet [l_") == 1
    first = {r["order_id"]: r for r in rows(X.orders(spark, SF_SMALL))}
    got = rows(posted)
    assert sorted(r["order_id"] for r in got) == sorted([*first, *(k for k in first if k % 7 == 3)])
    for r in got:
        o, again = first[r["order_id"]], r["payment_method"] == "repeat"
        ts = dt.datetime.strptime(o["created_at"], "%Y-%m-%dT%H:%M:%S") + dt.timedelta(days=again)
        assert r["ts"].replace(tzinfo=None) == ts and r["items"] == o["items"] and r["total"] == o["total"] and r["address"] == o["address"]
        assert (r["user_email"], r["delivery_speed"]) == ((o["user_email"].upper(), "express") if again else (o["user_email"], o["delivery_speed"]))
        assert again or r["payment_method"] == o["payment_method"]


def test_order_documents_stream_of_no_orders(spark, tmp_path):
    from catalytics.plans.queries import QUERIES
    for t in ("orders", "lineitem", "customer", "nation"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES["order_documents_stream"](spark, str(tmp_path)).collect() == []

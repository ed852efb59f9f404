"""Physical-plan properties that matter at scale."""

from catalytics.operators import aggregates as A
from catalytics.operators import ranking as R
from catalytics.plans.queries import QUERIES, scored
from helpers import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sales_window_filter_pushed_to_parquet(spark):
    """The start of the window is a scalar subquery (no job while the plan is built) and is pushed into the scan as its value."""
    from catalytics.sources.fixtures import units_by_part
    df = units_by_part(spark, SF_SMALL)
    assert "l_shipdate" in plan(df) and "ubquery" in plan(df)
    fixed = units_by_part(spark, SF_SMALL, as_of=df.sparkSession.read.parquet(f"{SF_SMALL}/lineitem.parquet").selectExpr("max(l_shipdate)").first()[0])
    assert "GreaterThan(l_shipdate" in plan(fixed)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, fixed.collect()))


def test_scan_prunes_columns(spark):
    p = plan(QUERIES["monthly_units"](spark, SF_SMALL))
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_shipdate:" in p


def test_top_k_per_group_limits_before_shuffle(spark):
    p = plan(R.category_top(scored(spark, SF_SMALL), 10))
    assert "WindowGroupLimit" in p


def test_global_top_k_is_take_ordered(spark):
    p = plan(R.predictions(scored(spark, SF_SMALL), 50))
    assert "TakeOrderedAndProject" in p


def test_no_python_udfs_in_registered_queries(spark):
    # jobs that run while they are built, and those with a model in Python inside (network, one category's clustering)
    skip = {"model_stats", "predict_demand", "train_demand_model", "adam_model_stats", "write_training_csv", "dataset_info"} | {
        n for n in QUERIES if "segment" in n or n.endswith("_stream") or n.startswith("stream_units")}
    for name, fn in QUERIES.items():
        if name in skip:
            continue
        p = plan(fn(spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_global_stats_are_a_scalar_subquery_not_a_join(spark):
    s = scored(spark, SF_SMALL)
    df = A.trends(s)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in p
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_with_row_fails_on_more_than_one_row(spark):
    import pytest
    from catalytics.functions.scalars import with_row
    base = spark.range(3)
    ok = with_row(base, spark.range(1).selectExpr("41 + 1 AS answer"))
    assert [r["answer"] for r in ok.collect()] == [42, 42, 42]
    with pytest.raises(Exception, match="(?i)more than one row|SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        with_row(base, spark.range(2).selectExpr("id AS answer")).collect()


def test_no_raw_rows_are_dealt_by_category_alone(spark):
    """With static broadcast off, as at scale, every exchange by the category alone carries aggregates."""
    import re
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("price_buckets", "price_distribution", "label_encode", "standardize"):
            text = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
            lines = text.splitlines()
            for k, line in enumerate(lines):
                if re.search(r"Exchange hashpartitioning\(categoryName#\d+, \d+\)", line):
                    below = " ".join(lines[k + 1:k + 3])
                    assert re.search("HashAggregate|SortAggregate|TakeOrdered", below), (name, line, below)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_users_orders_are_found_before_lines_are_grouped(spark):
    p = plan(QUERIES["user_orders"](spark, SF_SMALL))
    assert "LeftSemi" in p


def test_order_amounts_read_no_customers(spark):
    p = plan(QUERIES["order_totals"](spark, SF_SMALL))
    assert "customer" not in p and "collect_set" not in p

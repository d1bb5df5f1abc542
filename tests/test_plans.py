"""What the plans look like: pushed filters, pruned columns, top-k, split hot keys."""

import re

import pytest
from pyspark.sql import functions as F

from marketday.plans import marts, views
from marketday.sources.standin import RoleTables, latest_order_date


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_window_filter_reaches_the_header_scan_and_narrows_the_lines(spark, sf_dir):
    t = RoleTables(spark, sf_dir)
    plan = formatted(marts.build_fact(t, latest_order_date(t), 7))
    assert "GreaterThanOrEqual(o_orderdate,2001-07-25T00:00)" in plan
    assert re.search(r"l_orderkey#\d+L >= Subquery", plan)
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_extendedprice:double>" in plan


def test_views_read_only_what_is_used(spark, sf_dir):
    plan = formatted(views.orders_v(RoleTables(spark, sf_dir)).select("order_id", "price"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_extendedprice:double>" in plan
    assert "o_totalprice" not in plan


def test_country_month_is_a_pushed_range(spark, sf_dir):
    plan = formatted(views.country_month_items(RoleTables(spark, sf_dir), "ASIA", 1998, 2))
    assert "GreaterThanOrEqual(o_orderdate,1998-02-01T00:00)" in plan and "LessThan(o_orderdate,1998-03-01T00:00)" in plan


def test_caps_are_top_k_not_a_full_sort(spark, sf_dir):
    t = RoleTables(spark, sf_dir)
    assert "TakeOrderedAndProject" in physical(views.semantic_loyalty_v(t))
    assert "TakeOrderedAndProject" in physical(views.semantic_orders_v(t, order_by=["order_id"]))


@pytest.fixture
def no_broadcast(spark):
    """Small joins planned as big ones, and skew noticed at test size."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.files.maxPartitionBytes": "16KB",
        "spark.sql.files.openCostInBytes": "0",
    }
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def hot_lines(t):
    """The lines, a third of them moved to one order."""
    hot = t["order_header"].agg(F.max("order_id")).first()[0]
    moved = F.pmod(F.xxhash64("order_detail_id", "price"), F.lit(3)) == 0
    lines = t["order_detail"].withColumn("order_id", F.when(moved, hot).otherwise(F.col("order_id")))
    lines = lines.repartition(16, "price").persist()
    assert lines.filter(F.col("order_id") == hot).count() > 0.3 * lines.count()
    return lines


def test_an_order_with_a_third_of_all_lines_is_split(spark, sf_dir, no_broadcast):
    t = RoleTables(spark, sf_dir)
    t["order_detail"] = hot_lines(t)
    orders = views.orders_v(t)
    fact = marts.daily_item_sales(orders)
    got = fact.agg(F.sum("order_lines"), F.sum("gross_sales")).first()
    assert tuple(got) == tuple(orders.agg(F.count(F.lit(1)), F.sum("price")).first())
    assert len(fact.collect()) > 0
    assert "skew=true" in physical(fact)
    t["order_detail"].unpersist()


@pytest.mark.parametrize("force", ["true", "false"])
def test_a_hot_join_key_is_split_below_a_grouping_by_the_same_key(spark, sf_dir, no_broadcast, force):
    """The reason for the force setting: without it the grouping pins the join's partitioning."""
    t = RoleTables(spark, sf_dir)
    lines = hot_lines(t)
    old = spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", force)
    try:
        df = lines.join(t["order_header"], "order_id").groupBy("order_id", "menu_item_id").agg(F.sum("price").alias("s"))
        assert len(df.collect()) > 0
        assert ("skew=true" in physical(df)) == (force == "true")
    finally:
        spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", old)
        lines.unpersist()


def test_facts_of_most_orders_shuffle_lines_for_their_headers_and_items_only(spark, sf_dir):
    t = RoleTables(spark, sf_dir)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        fact = marts.daily_item_sales(views.orders_v(t, t["order_header"], t["order_detail"], most=True))
        plan = physical(fact)
        window = marts.daily_item_sales(views.orders_v(t, t["order_header"], t["order_detail"]))
        assert sorted(map(tuple, fact.collect()), key=str) == sorted(map(tuple, window.collect()), key=str)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    top = plan[: plan.index("hashpartitioning(")]
    assert top.count("SortMergeJoin") == 1 and "menu_item_id" in plan[len(top) :].split("\n")[0]  # no shuffle above the menu's join
    assert len(re.findall(r"hashpartitioning\(menu_item_id", plan)) == 2  # the lines, the menu

"""Lines and headers stored by order id: no shuffle between them, large orders beside, nothing lost."""

import re

import pytest
from pyspark.sql import functions as F
from test_plans import physical

from marketday.plans import views
from marketday.session import scratch_path
from marketday.sources.buckets import DETAIL, HEADER, ByOrder, buckets_for, store_by_order
from marketday.sources.standin import RoleTables

BUCKETS = 4


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def hot(spark, sf_dir):
    """A third of all lines on one order, some lines and headers without an order id, a header without lines."""
    t = RoleTables(spark, sf_dir)
    dealt = F.pmod(F.xxhash64("order_detail_id", "price"), F.lit(30))
    one = t[HEADER].agg(F.max("order_id")).first()[0]
    t[DETAIL] = t[DETAIL].withColumn("order_id", F.when(dealt < 10, one).when(dealt < 29, F.col("order_id")))
    t[HEADER] = t[HEADER].withColumn("order_id", F.when(F.col("order_id") % 40 != 0, F.col("order_id")))
    return t, one


def stored(spark, t):
    root = scratch_path(spark, "by-order")
    store_by_order(t[DETAIL], t[HEADER], root, BUCKETS)
    return ByOrder(spark, root, BUCKETS)


def digest(df):
    """Rows as a multiset: their number and the sum of their hashes."""
    columns = sorted(df.columns)
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first())


def test_lines_meet_headers_without_a_shuffle(spark, sf_dir, no_broadcast):
    t = RoleTables(spark, sf_dir)
    s = stored(spark, t)
    lines, header = s.bucketed(DETAIL), s.bucketed(HEADER).select("order_id", "order_ts")
    joined = lines.join(header, "order_id")
    assert joined.count() > 0
    plan = physical(joined)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count(f"SelectedBucketsCount: {BUCKETS} out of {BUCKETS}") == 2
    # nor do groups by order id that follow
    assert "Exchange" not in physical(joined.groupBy("order_id").agg(F.sum("price")))
    assert "Exchange" in physical(t[DETAIL].join(t[HEADER].select("order_id", "order_ts"), "order_id"))


def test_one_file_a_bucket(spark, sf_dir):
    s = stored(spark, RoleTables(spark, sf_dir))
    files = s.bucketed(DETAIL).select(F.input_file_name().alias("f")).distinct().collect()
    buckets = [re.search(r"_(\d{5})\.c", r["f"]).group(1) for r in files]
    assert len(buckets) == len(set(buckets)) <= BUCKETS


def test_a_large_order_is_kept_beside_and_nothing_is_lost(spark, sf_dir, no_broadcast):
    t, one = hot(spark, sf_dir)
    s = stored(spark, t)
    for name in (DETAIL, HEADER):
        assert digest(s.table(name)) == digest(t[name])
    assert s.bucketed(DETAIL).filter(F.col("order_id") == one).isEmpty()
    assert digest(views.orders_v(t, sold=s.joined())) == digest(views.orders_v(t))


def test_a_day_range_goes_to_the_headers(spark, sf_dir):
    t, _ = hot(spark, sf_dir)
    since = F.col("order_ts") >= F.lit("2001-01-01").cast("timestamp_ntz")
    assert digest(views.orders_v(t, sold=stored(spark, t).joined(since))) == digest(views.orders_v(t, t[HEADER].filter(since)))


def test_empty_tables_and_the_wrong_number_of_buckets(spark, sf_dir):
    t = RoleTables(spark, sf_dir)
    empty = stored(spark, {name: t[name].limit(0) for name in (DETAIL, HEADER)})
    assert empty.joined().count() == 0 and empty.table(DETAIL).count() == 0
    assert buckets_for(t[DETAIL]) == 8 and buckets_for(t[DETAIL], 100) == -(-t[DETAIL].count() // 800) * 8
    with pytest.raises(FileNotFoundError):
        ByOrder(spark, empty.root, BUCKETS + 1).joined()

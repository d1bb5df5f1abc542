import datetime as dt
import re
from decimal import Decimal

import pytest

from marketday import session
from marketday.plans import views
from marketday.sources.schemas import RAW, names
from marketday.sources.standin import RoleTables


def table(spark, role, *rows):
    """Rows given as dicts; columns left out are NULL."""
    cols = names(RAW[role])
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], RAW[role])


@pytest.fixture(scope="module")
def t(spark):
    def order(i, truck, place, buyer, total, ts):
        return dict(order_id=i, truck_id=truck, location_id=place, customer_id=buyer, order_total=Decimal(total), order_ts=ts)

    day = dt.datetime(2022, 2, 28, 23, 59)
    return {
        "order_header": table(
            spark, "order_header",
            order(1, 1, 5.0, 100, 10, day), order(2, 1, 6.0, 100, 20, dt.datetime(2022, 3, 1)),
            order(3, 2, 5.0, 999, 30, day), order(4, 3, 5.0, 100, 40, day), order(5, 1, 5.5, 100, 50, day),
        ),
        "order_detail": table(spark, "order_detail", *[
            dict(order_detail_id=10 * o + n, order_id=o, menu_item_id=m, line_number=n, quantity=1, price=Decimal(p))
            for o, n, m, p in [(1, 1, 7, 4), (1, 2, 8, 6), (2, 1, 7, 20), (3, 1, 7, 30), (4, 1, 7, 40), (5, 1, 7, 50)]
        ]),
        "truck": table(
            spark, "truck",
            dict(truck_id=1, menu_type_id=1, country="Japan", franchise_id=1, primary_city="Tokyo"),
            dict(truck_id=2, menu_type_id=2, country="Japan", franchise_id=1, primary_city="Kyoto"),
            dict(truck_id=3, menu_type_id=1, country="Japan", franchise_id=77, franchise_flag=0),
        ),
        "menu": table(
            spark, "menu",
            dict(menu_item_id=7, menu_item_name="ramen", menu_type_id=1, truck_brand_name="B"),
            dict(menu_item_id=8, menu_item_name="tea", menu_type_id=1, truck_brand_name="B"),
            dict(menu_item_id=9, menu_item_name="pie", menu_type_id=2, truck_brand_name="C"),
            dict(menu_item_id=10, menu_item_name="cake", menu_type_id=2, truck_brand_name="D"),
        ),
        "franchise": table(spark, "franchise", dict(franchise_id=1, first_name="F", last_name="L")),
        "location": table(spark, "location", dict(location_id=5), dict(location_id=6)),
        "customer_loyalty": table(spark, "customer_loyalty", dict(customer_id=100, first_name="Ann", city="X", country="Y")),
        "truck_reviews": table(
            spark, "truck_reviews",
            dict(order_id=3, review_id=1, review="good"), dict(order_id=3, review_id=1, review="good"),
            dict(order_id=3, review_id=2, review="good"), dict(order_id=99, review_id=3, review="lost"),
        ),
    }


def test_orders(t):
    rows = views.orders_v(t).orderBy("order_detail_id").collect()
    # No franchise for truck 3 and no location 5.5: their orders drop out.
    assert [r["order_detail_id"] for r in rows] == [11, 12, 21, 31]
    assert [r["customer_id"] for r in rows] == [100, 100, 100, None]  # the member's key, not the buyer's
    assert (rows[0]["first_name"], rows[0]["franchisee_first_name"], rows[0]["location_id"]) == ("Ann", "F", 5)
    assert list(rows[0].asDict()) == views.ORDER_COLUMNS and len(views.ORDER_COLUMNS) == 32


def test_loyalty_counts_each_order_once_and_the_semantic_twin_each_line(t):
    (row,) = views.loyalty_metrics_v(t).collect()
    assert row["total_sales"] == 120 and sorted(row["visited_location_ids_array"]) == [5, 6]
    (row,) = views.semantic_loyalty_v(t).collect()
    assert (row["customer_id"], row["total_sales"], row["visited_location_ids_array"]) == ("100", 40, ["5", "6"])


def test_reviews_are_distinct_over_brands(t):
    rows = sorted((r["review_id"], r["truck_brand_name"]) for r in views.reviews_v(t).collect())
    assert rows == [(1, "C"), (1, "D"), (2, "C"), (2, "D")]


def test_country_month(t):
    rows = sorted(tuple(r) for r in views.country_month_items(t, "Japan", 2022, 2).collect())
    day = dt.date(2022, 2, 28)
    assert rows == [("ramen", day, 10), ("ramen", day, 30), ("tea", day, 10)]


def test_analytics_orders_start_with_the_date(t):
    df = views.analytics_orders_v(t)
    assert df.columns == ["date", *views.ORDER_COLUMNS]


def test_semantic_orders_cap(t):
    df = views.semantic_orders_v(t, cap=2, order_by=["order_detail_id"])
    assert [r["order_detail_id"] for r in df.collect()] == ["11", "12"]
    assert views.semantic_orders_v(t, cap=3).count() == 3 and len(df.columns) == 18
    assert views.semantic_orders_v(t).count() == 4


def test_views_for_sql(spark, t):
    assert len(views.create_views(t)) == 9
    got = spark.sql("SELECT menu_item_name, order_total FROM analytics_japan_menu_item_sales_feb_2022").collect()
    assert len(got) == 3
    got = spark.sql("SELECT count(*) AS n, sum(quantity) AS q FROM analytics_orders_v WHERE date < DATE'2022-03-01'").first()
    assert tuple(got) == (3, 3)
    assert spark.table("semantic_layer_orders_v").count() == 4


def test_headers_take_their_dimensions_before_the_lines(spark, sf_dir):
    """Lines with all columns pass one shuffle, the menu's: members, trucks and places are joined to headers, below the lines' join."""
    orders = views.orders_v(RoleTables(spark, sf_dir))
    plan = orders._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {name: next(re.search(r"[A-Za-z]", line).start() for line in plan if name in line and "Relation" in line)
             for name in ("l_orderkey", "c_custkey", "s_suppkey", "p_partkey")}
    assert depth["p_partkey"] < depth["l_orderkey"] < min(depth["c_custkey"], depth["s_suppkey"])


def test_a_task_reads_at_most_its_share(spark):
    key, old = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        for before, after in (("64MB", str(16 << 20) + "b"), ("8m", "8m")):
            spark.conf.set(key, before)
            assert session.tune(spark).conf.get(key) == after
    finally:
        spark.conf.set(key, old)

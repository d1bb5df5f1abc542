"""Registered queries: the layered views."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketday.plans import views
from marketday.registry.base import Registry, roles, with_roles
from marketday.session import scratch_path
from marketday.sources.buckets import ByOrder, buckets_for, store_by_order

R = Registry()

_MONEY = {"unit_price", "price", "order_amount", "order_total"}
_LONG = {"franchise_flag", "franchise_id", "location_id"}


def _sql_columns(columns):
    out = []
    for c in columns:
        if c in _MONEY:
            out.append(f"CAST({c} AS DOUBLE) AS {c}")
        elif c in _LONG:
            out.append(f"CAST({c} AS BIGINT) AS {c}")
        elif c == "order_ts":
            out.append("strftime(order_ts, '%Y-%m-%d %H:%M:%S') AS order_ts")
        elif c == "date":
            out.append("CAST(date AS VARCHAR) AS date")
        else:
            out.append(c)
    return ", ".join(out)


@R.add("v_orders", with_roles(f"SELECT {_sql_columns(views.ORDER_COLUMNS)} FROM orders_v"))
def v_orders(spark, sf_dir):
    return views.orders_v(roles(spark, sf_dir))


@R.add("v_orders_bucketed", with_roles(f"SELECT {_sql_columns(views.ORDER_COLUMNS)} FROM orders_v"))
def v_orders_bucketed(spark, sf_dir):
    """The same from lines and headers that were dealt by order id when they were stored: the two meet without a shuffle."""
    t, root = roles(spark, sf_dir), scratch_path(spark, "by-order")
    buckets = buckets_for(t["order_detail"])
    store_by_order(t["order_detail"], t["order_header"], root, buckets)
    return views.orders_v(t, sold=ByOrder(spark, root, buckets).joined())


@R.add("v_analytics_orders", with_roles(f"SELECT {_sql_columns(['date', *views.ORDER_COLUMNS])} FROM orders_v"))
def v_analytics_orders(spark, sf_dir):
    return views.analytics_orders_v(roles(spark, sf_dir))


_LOYALTY = with_roles("""
SELECT c.customer_id, c.city, c.country, c.first_name, c.last_name, c.phone_number, c.e_mail,
       CAST(sum(h.order_total) AS DOUBLE) AS total_sales,
       list_aggregate(list_sort(list(DISTINCT CAST(h.location_id AS BIGINT))), 'string_agg', ',') AS locations
FROM customer_loyalty c JOIN order_header h ON c.customer_id = h.customer_id
GROUP BY ALL""")


def _loyalty(df):
    places = F.array_join(F.sort_array("visited_location_ids_array").cast("array<string>"), ",")
    return df.withColumn("locations", places).drop("visited_location_ids_array")


@R.add("v_loyalty_metrics", _LOYALTY)
def v_loyalty_metrics(spark, sf_dir):
    return _loyalty(views.loyalty_metrics_v(roles(spark, sf_dir)))


@R.add("v_analytics_loyalty_metrics", _LOYALTY)
def v_analytics_loyalty_metrics(spark, sf_dir):
    return _loyalty(views.analytics_loyalty_metrics_v(roles(spark, sf_dir)))


_REVIEWS = with_roles("""
SELECT DISTINCT r.review_id, r.order_id, h.truck_id, r.language, r.source, md5(r.review) AS review_md5,
       length(r.review) AS review_chars, t.primary_city, h.customer_id,
       CAST(CAST(h.order_ts AS DATE) AS VARCHAR) AS date, m.truck_brand_name
FROM truck_reviews r JOIN order_header h ON h.order_id = r.order_id
JOIN truck t ON t.truck_id = h.truck_id JOIN menu m ON m.menu_type_id = t.menu_type_id""")


def _reviews(df):
    return df.withColumn("review_md5", F.md5("review")).withColumn("review_chars", F.length("review")).drop("review")


@R.add("v_reviews", _REVIEWS)
def v_reviews(spark, sf_dir):
    return _reviews(views.reviews_v(roles(spark, sf_dir)))


@R.add("v_analytics_reviews", _REVIEWS)
def v_analytics_reviews(spark, sf_dir):
    return _reviews(views.analytics_reviews_v(roles(spark, sf_dir)))


@R.add("v_country_month_items", with_roles("""
SELECT DISTINCT menu_item_name, CAST(date AS VARCHAR) AS date, CAST(order_total AS DOUBLE) AS order_total
FROM orders_v WHERE country = 'ASIA' AND year(date) = 1998 AND month(date) = 2"""))
def v_country_month_items(spark, sf_dir):
    return views.country_month_items(roles(spark, sf_dir), "ASIA", 1998, 2)


@R.add("v_semantic_orders", with_roles(f"""
SELECT * REPLACE (CAST(order_total AS DOUBLE) AS order_total) FROM (
  SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(truck_id AS VARCHAR) AS truck_id,
         CAST(order_detail_id AS VARCHAR) AS order_detail_id, truck_brand_name, menu_type, primary_city,
         region, country, CAST(franchise_flag AS BIGINT) AS franchise_flag,
         CAST(franchise_id AS VARCHAR) AS franchise_id, CAST(location_id AS VARCHAR) AS location_id,
         CAST(customer_id AS VARCHAR) AS customer_id, gender, marital_status,
         CAST(menu_item_id AS VARCHAR) AS menu_item_id, menu_item_name, quantity, order_total
  FROM orders_v)
ORDER BY {", ".join(f"{c} NULLS FIRST" for c in views.SEMANTIC_COLUMNS)} LIMIT 10000"""))
def v_semantic_orders(spark, sf_dir):
    """The capped view in a total order, so that the cap keeps the same rows everywhere."""
    return views.semantic_orders_v(roles(spark, sf_dir), order_by=views.SEMANTIC_COLUMNS)


@R.add("v_semantic_loyalty", with_roles("""
SELECT CAST(customer_id AS VARCHAR) AS customer_id, city, country, total_sales, locations FROM (
  SELECT c.customer_id, c.city, c.country, CAST(sum(o.order_total) AS DOUBLE) AS total_sales,
         list_aggregate(list_sort(list(DISTINCT CAST(o.location_id AS VARCHAR))), 'string_agg', ',') AS locations
  FROM customer_loyalty c JOIN orders_v o ON c.customer_id = o.customer_id
  GROUP BY ALL ORDER BY c.customer_id LIMIT 100)"""))
def v_semantic_loyalty(spark, sf_dir):
    df = views.semantic_loyalty_v(roles(spark, sf_dir), cap=100)
    return df.withColumn("locations", F.array_join("visited_location_ids_array", ",")).drop("visited_location_ids_array")

"""The two sales marts: daily item facts and daily brand KPIs, over a trailing window of days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketday.functions.scalar import safe_divide
from marketday.operators.rebuild import cutoff_date, in_window
from marketday.plans.views import Tables, orders_v

DEFAULT_DAYS = 7  # fixed value

FACT_KEYS = "date menu_item_id menu_item_name truck_brand_name country location_id".split()


def window_orders(t: Tables, as_of: dt.date, days_back: int) -> DataFrame:
    """The order view from the cutoff day on.

    The day filter is written on the raw timestamp, so it reaches the header's Parquet scan.  The
    line table has no date; its scan is narrowed by the smallest and largest order id of the
    window, which skips row groups and files where ids grow with time.
    """
    recent = t["order_header"].filter(F.col("order_ts") >= F.lit(cutoff_date(as_of, days_back)))
    return orders_v(t, recent, lines_between(t["order_detail"], recent))


def lines_between(lines: DataFrame, header: DataFrame) -> DataFrame:
    """The order lines from the smallest to the largest order id of these headers."""
    return lines.filter(
        (F.col("order_id") >= header.select(F.min("order_id")).scalar())
        & (F.col("order_id") <= header.select(F.max("order_id")).scalar())
    )


def daily_item_sales(orders: DataFrame) -> DataFrame:
    """Sales per day, item and location.

    Gross and net sales are both the sum of line prices.  ``orders_count`` counts an order once per
    item and location it appears under.  Keys turn into text after the grouping, which then needs no shuffle of
    its own where the menu's join has dealt the lines by item.
    """
    sold = F.sum("price").cast("decimal(38,2)")
    return orders.groupBy(
        F.to_date("order_ts").alias("date"), "menu_item_id", "menu_item_name", "truck_brand_name", "country", "location_id",
    ).agg(
        F.count_distinct("order_id").alias("orders_count"),
        F.count(F.lit(1)).alias("order_lines"),
        F.sum("quantity").alias("quantity"),
        sold.alias("gross_sales"),
        sold.alias("net_sales"),
    ).withColumns({key: F.col(key).cast("string") for key in ("menu_item_id", "location_id")})


def build_fact(t: Tables, as_of: dt.date, days_back: int = DEFAULT_DAYS) -> DataFrame:
    return daily_item_sales(window_orders(t, as_of, days_back))


def brand_kpi(fact: DataFrame, orders: DataFrame, per_line: bool = False) -> DataFrame:
    """Per day and brand: order, line, quantity and sales totals, order value, distinct members.

    The definition joins facts to order lines on (brand, day), many to many.  Here each side is
    aggregated to one row per (brand, day) first and the join is one to one.  By default totals are
    the fact's own; ``per_line=True`` gives the totals of the literal join, where each fact row is
    counted once per order line of its brand and day (once where there is no line).
    ``total_orders`` adds up per-item counts, so an order with two items counts twice.
    """
    totals = fact.groupBy("date", "truck_brand_name").agg(
        F.sum("orders_count").alias("total_orders"),
        F.sum("order_lines").alias("total_order_lines"),
        F.sum("quantity").alias("total_quantity"),
        F.sum("net_sales").cast("decimal(38,2)").alias("total_sales"),
    )
    buyers = orders.groupBy(F.to_date("order_ts").alias("date"), "truck_brand_name").agg(
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count(F.lit(1)).alias("lines"),
    )
    joined = totals.join(buyers, ["date", "truck_brand_name"], "left")
    times = F.greatest(F.coalesce("lines", F.lit(1)), F.lit(1)) if per_line else F.lit(1)
    return joined.select(
        "date", "truck_brand_name",
        (F.col("total_orders") * times).alias("total_orders"),
        (F.col("total_order_lines") * times).alias("total_order_lines"),
        (F.col("total_quantity") * times).alias("total_quantity"),
        (F.col("total_sales") * times).cast("decimal(38,2)").alias("total_sales"),
        # Decimal by decimal, with 13 digits to spare before the value is rounded to cents.
        safe_divide(F.col("total_sales").cast("decimal(27,2)"), F.col("total_orders").cast("decimal(12,0)"))
        .cast("decimal(38,2)").alias("avg_order_value"),
        F.coalesce("unique_customers", F.lit(0)).alias("unique_customers"),
    )


def build_kpi(
    fact: DataFrame, orders: DataFrame, as_of: dt.date, days_back: int = DEFAULT_DAYS, per_line: bool = False
) -> DataFrame:
    return brand_kpi(fact.filter(in_window(F.col("date"), cutoff_date(as_of, days_back))), orders, per_line)


def order_bitmaps(orders: DataFrame) -> DataFrame:
    """Per day, brand and block of 32 768 order ids: the ids present, one bit each (4 KB a block).

    Unlike a daily distinct count it can be added up: an order that shows on several days, items or locations sets the
    same bit again.  Built with map-side combination, so a day's block costs one row a task whatever the number of lines.
    Where order ids grow with time a day touches few blocks.
    """
    known = orders.filter(F.col("order_id").isNotNull())
    return known.groupBy(
        F.to_date("order_ts").alias("date"), "truck_brand_name", F.bitmap_bucket_number("order_id").alias("block"),
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position("order_id")).alias("orders"))


def distinct_orders(bitmaps: DataFrame, cutoff: dt.date, by: tuple[str, ...] = ("truck_brand_name",)) -> DataFrame:
    """Distinct orders from the cutoff day on, by brand or (``by`` empty) over all brands, from the bitmaps alone."""
    merged = bitmaps.filter(in_window(F.col("date"), cutoff)).groupBy(*by, "block").agg(F.bitmap_or_agg("orders").alias("orders"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("orders")).alias("distinct_orders"))

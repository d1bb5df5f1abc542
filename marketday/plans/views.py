"""The warehouse's layered views as functions from raw tables to a DataFrame.

Nothing is hinted: the joins run from the biggest table outwards, Spark broadcasts a dimension when
its measured size is below the threshold and shuffles it otherwise, and AQE splits hot keys.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]

# The output columns of the line-grain order view and of its text-keyed twin.
ORDER_COLUMNS = (
    "order_id truck_id order_ts order_detail_id line_number truck_brand_name menu_type primary_city "
    "region country franchise_flag franchise_id franchisee_first_name franchisee_last_name "
    "location_id customer_id first_name last_name e_mail phone_number children_count gender "
    "marital_status menu_item_id menu_item_name quantity unit_price price order_amount "
    "order_tax_amount order_discount_amount order_total"
).split()
SEMANTIC_COLUMNS = (
    "order_id truck_id order_detail_id truck_brand_name menu_type primary_city region country "
    "franchise_flag franchise_id location_id customer_id gender marital_status menu_item_id "
    "menu_item_name quantity order_total"
).split()
SEMANTIC_TEXT_KEYS = {
    "order_id", "truck_id", "order_detail_id", "franchise_id", "location_id", "customer_id",
    "menu_item_id",
}
MEMBER_KEYS = "customer_id city country first_name last_name phone_number e_mail".split()
SEMANTIC_CAP = 10_000
# --- end of fixed values ---


def whole_key(col):
    """A floating point key as the integer it stands for, so that it joins (and prints) as one.

    A value with a fraction stands for no key and becomes NULL, as it would match none.
    """
    return F.when(col == F.floor(col), col.try_cast("bigint"))


def _with_parties(t: Tables, sold: DataFrame) -> DataFrame:
    """Location, member (where the buyer is one), truck and its owner to every row; the widest come last, to be shuffled least."""
    owners = t["franchise"].select(
        "franchise_id",
        F.col("first_name").alias("franchisee_first_name"),
        F.col("last_name").alias("franchisee_last_name"),
    )
    members = t["customer_loyalty"].select(
        F.col("customer_id").alias("member_id"), "first_name", "last_name", "e_mail", "phone_number",
        "children_count", "gender", "marital_status",
    )
    return (
        sold.withColumn("location_id", whole_key(F.col("location_id")))
        .join(t["location"].select("location_id"), "location_id")
        .withColumnRenamed("customer_id", "buyer_id")
        .join(members, F.col("buyer_id") == F.col("member_id"), "left")
        .withColumnRenamed("member_id", "customer_id")  # the member's key: NULL for other buyers
        .join(t["truck"].drop("menu_type_id").join(owners, "franchise_id"), "truck_id")
    )


def orders_v(
    t: Tables, header: DataFrame | None = None, lines: DataFrame | None = None, sold: DataFrame | None = None, most: bool = False
) -> DataFrame:
    """Line-grain star join: five inner joins, and members attached where the customer is one.

    ``header`` and ``lines`` may be already narrowed order headers and lines (a date window), or ``sold`` the two
    joined by order id, as ``sources.buckets.ByOrder.joined`` gives them.  ``most``: the window may hold most of the orders.
    """
    menu = t["menu"].select("menu_item_id", "menu_item_name", "menu_type", "truck_brand_name")
    if sold is None and (header is None or most):
        # All orders, or most of them: headers, of which there are fewer, take their dimensions before the lines meet them; after that only
        # the menu's join may shuffle lines with all columns.
        lines = (t["order_detail"] if lines is None else lines).drop("discount_id")
        joined = lines.join(_with_parties(t, t["order_header"] if header is None else header), "order_id").join(menu, "menu_item_id")
    else:
        # A window: the lines meet its headers first, as that drops most of them.
        if sold is None:
            sold = (t["order_detail"] if lines is None else lines).drop("discount_id").join(header, "order_id")
        joined = _with_parties(t, sold.join(menu, "menu_item_id"))
    return joined.select(*ORDER_COLUMNS)


def loyalty_metrics_v(t: Tables) -> DataFrame:
    """Per member: order total at order grain, and the set of visited locations.

    Orders are first summed per (customer, location), which combines on the map side; a customer
    holding a third of all orders reaches the join as a handful of rows.
    """
    visits = (
        t["order_header"]
        .groupBy("customer_id", whole_key(F.col("location_id")).alias("location_id"))
        .agg(F.sum("order_total").alias("spent"))
    )
    return (
        t["customer_loyalty"].select(*MEMBER_KEYS)
        .join(visits, "customer_id")
        .groupBy(*MEMBER_KEYS)
        .agg(
            F.sum("spent").alias("total_sales"),
            F.collect_set("location_id").alias("visited_location_ids_array"),
        )
    )


def reviews_v(t: Tables) -> DataFrame:
    """Reviews with their truck and each brand sold under the truck's menu type, distinct rows.

    Both sides are made distinct before they meet, each on all of its own columns.  The joined rows
    are then distinct by themselves, so the review text is never part of a many-to-many blow-up
    that a later DISTINCT would have to shuffle again.
    """
    # Dealt out by the join's key before they are made distinct: one shuffle of the texts serves both.
    reviews = t["truck_reviews"].repartition("order_id").distinct()
    brands = t["menu"].select("menu_type_id", "truck_brand_name").distinct()
    sold = (
        t["order_header"].select("order_id", "truck_id", "customer_id", F.to_date("order_ts").alias("date"))
        .join(t["truck"].select("truck_id", "menu_type_id", "primary_city"), "truck_id")
        .join(t["truck_reviews"].select("order_id"), "order_id", "left_semi")
        .join(brands, "menu_type_id")
        .drop("menu_type_id")
        .distinct()
    )
    return reviews.join(sold, "order_id").select(
        "review_id", "order_id", "truck_id", "language", "source", "review", "primary_city",
        "customer_id", "date", "truck_brand_name",
    )


def analytics_orders_v(t: Tables) -> DataFrame:
    return orders_v(t).select(F.to_date("order_ts").alias("date"), "*")


def analytics_loyalty_metrics_v(t: Tables) -> DataFrame:
    return loyalty_metrics_v(t)


def analytics_reviews_v(t: Tables) -> DataFrame:
    return reviews_v(t)


def country_month_items(t: Tables, country: str, year: int, month: int) -> DataFrame:
    """Distinct (item, day, order total) of one country and month.

    The month is a half-open range on the raw timestamp, which reaches the Parquet scan.
    """
    first = dt.date(year, month, 1)
    after = (first + dt.timedelta(days=32)).replace(day=1)
    ts = F.col("order_ts")
    header = t["order_header"].filter((ts >= F.lit(first)) & (ts < F.lit(after)))
    return (
        orders_v(t, header).filter(F.col("country") == country)
        .select("menu_item_name", F.to_date("order_ts").alias("date"), "order_total")
        .distinct()
    )


def semantic_orders_v(t: Tables, cap: int | None = SEMANTIC_CAP, order_by: list[str] | None = None) -> DataFrame:
    """Eighteen columns with keys as text, capped.

    The cap is part of the view.  Without ``order_by`` it keeps any rows; with it, the first ones.
    """
    view = orders_v(t).select(
        *[F.col(c).cast("string").alias(c) if c in SEMANTIC_TEXT_KEYS else F.col(c) for c in SEMANTIC_COLUMNS]
    )
    if order_by:
        view = view.orderBy(*order_by)
    return view.limit(cap) if cap is not None else view


def semantic_loyalty_v(t: Tables, cap: int | None = SEMANTIC_CAP) -> DataFrame:
    """Per member: order total summed once per order *line*, and sorted distinct location texts.

    Differs from ``loyalty_metrics_v``, which counts each order once; both are kept as defined.
    Members sort by number, before the key turns into text.
    """
    spent = (
        orders_v(t).filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id", F.col("location_id").cast("string").alias("location"))
        .agg(F.sum("order_total").alias("spent"))
    )
    # The members of the loyalty view that have orders here: a line's customer is a member with an
    # order, so the view's own join to the orders would keep the same rows.
    members = t["customer_loyalty"].select(*MEMBER_KEYS).distinct()
    out = (
        members.join(spent, "customer_id")
        .groupBy("customer_id", "city", "country")
        .agg(
            F.sum("spent").alias("total_sales"),
            F.sort_array(F.collect_set("location")).alias("visited_location_ids_array"),
        )
        .orderBy("customer_id")
    )
    if cap is not None:
        out = out.limit(cap)
    return out.withColumn("customer_id", F.col("customer_id").cast("string"))


# Layer and name of each view, as SQL users know them.
VIEWS = {
    "harmonized_orders_v": orders_v,
    "harmonized_customer_loyalty_metrics_v": loyalty_metrics_v,
    "harmonized_truck_reviews_v": reviews_v,
    "analytics_orders_v": analytics_orders_v,
    "analytics_customer_loyalty_metrics_v": analytics_loyalty_metrics_v,
    "analytics_truck_reviews_v": analytics_reviews_v,
    "analytics_japan_menu_item_sales_feb_2022": lambda t: country_month_items(t, "Japan", 2022, 2),
    "semantic_layer_orders_v": semantic_orders_v,
    "semantic_layer_customer_loyalty_metrics_v": semantic_loyalty_v,
}


def create_views(t: Tables) -> list[str]:
    """Register every view for SQL, lazily, as ``<layer>_<name>``; the names."""
    for name, view in VIEWS.items():
        view(t).createOrReplaceTempView(name)
    return list(VIEWS)

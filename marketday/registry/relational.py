"""Registered queries: projections, filters, joins, aggregations, windows, top-k and set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketday.functions.scalar import safe_divide
from marketday.operators import checks
from marketday.operators.order_stats import band_bits, group_order_stats, trailing_order_stats, units
from marketday.operators.ranges import trailing_join, trailing_sums_at
from marketday.operators.rebuild import cutoff_date, in_window
from marketday.operators.trailing import (
    daily_moments, sample_sd, trailing_moments, trailing_sums_by_frame, trailing_sums_by_join,
)
from marketday.plans import lineage, marts, views
from marketday.registry.base import (
    AS_OF, Registry, brand_fact, roles, shown, shown_sql, source, stored, with_fact, with_roles,
)

R = Registry()


def _history(spark, sf_dir):
    """Daily facts of all days, brand as the item."""
    return brand_fact(marts.daily_item_sales(views.orders_v(roles(spark, sf_dir))))


# ---- projection ---------------------------------------------------------------------------------


@R.add("prj_keys_to_string", with_roles("""
SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(truck_id AS VARCHAR) AS truck_id,
       CAST(CAST(location_id AS BIGINT) AS VARCHAR) AS location_id,
       CAST(customer_id AS VARCHAR) AS customer_id
FROM order_header"""))
def prj_keys_to_string(spark, sf_dir):
    """Keys as text; the floating point one prints without a fraction."""
    return roles(spark, sf_dir)["order_header"].select(
        F.col("order_id").cast("string"), F.col("truck_id").cast("string"),
        views.whole_key(F.col("location_id")).cast("string").alias("location_id"),
        F.col("customer_id").cast("string"),
    )


# ---- filters ------------------------------------------------------------------------------------


@R.add("flt_trailing_days", f"""
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_totalprice
FROM orders WHERE CAST(o_orderdate AS DATE) >= {AS_OF} - 60""")
def flt_trailing_days(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    as_of = orders.agg(F.to_date(F.max("o_orderdate"))).first()[0]
    day = F.to_date("o_orderdate")
    return orders.filter(in_window(day, cutoff_date(as_of, 60))).select(
        "o_orderkey", day.alias("day"), "o_totalprice"
    )


@R.add("flt_year_month_text", """
SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1998 AND month(o_orderdate) = 2""")
def flt_year_month_text(spark, sf_dir):
    """Year and month given as text: cast to numbers, then one range of days."""
    first = F.make_date(F.lit("1998").cast("int"), F.lit("2").cast("int"), F.lit(1))
    day = F.col("o_orderdate")  # a half-open range reaches the scan
    return source(spark, sf_dir, "orders").filter((day >= first) & (day < F.add_months(first, 1))).select("o_orderkey", "o_totalprice")


# ---- data-quality predicates over whole tables --------------------------------------------------


@R.add("dq_null_keys", with_roles("""
, bad AS (SELECT order_id, order_detail_id, country FROM orders_v WHERE customer_id IS NULL OR e_mail IS NULL)
SELECT (SELECT count(*) FROM bad) AS failed_count, 'FAIL' AS status,
       '{"sample_rows":[' || string_agg('{"order_id":' || order_id || ',"order_detail_id":' || order_detail_id
          || ',"country":"' || country || '"}', ',' ORDER BY order_id, order_detail_id, country) || ']}' AS sample_rows
FROM (SELECT * FROM bad ORDER BY order_id, order_detail_id, country LIMIT 10)"""))
def dq_null_keys(spark, sf_dir):
    """Rows with a NULL among the keys, counted, with ten of them as JSON (NULL fields left out)."""
    lines = views.orders_v(roles(spark, sf_dir)).select("order_id", "order_detail_id", "country", "customer_id", "e_mail")
    bad = checks.any_null(["customer_id", "e_mail"])
    lines = stored(lines.filter(bad))  # the failing rows, found by one star join; both parts read them
    sample = checks.sample_json(lines, bad, ["order_id", "order_detail_id", "country"])
    counts = lines.agg(checks.failing(bad).alias("failed_count"))
    rows = checks.log_rows(counts, checks.result("NULL_KEYS", "ERROR", "", sample=sample.scalar()))
    return rows.select("failed_count", "status", "sample_rows")


@R.add("dq_non_negative", """
SELECT count(*) FILTER (WHERE margin < 0 OR l_quantity < 0) AS failed_count,
       CASE WHEN count(*) FILTER (WHERE margin < 0 OR l_quantity < 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT l_quantity, l_extendedprice - 50 * p_retailprice AS margin
      FROM lineitem JOIN part ON l_partkey = p_partkey)""")
def dq_non_negative(spark, sf_dir):
    """Rows where any of several measures is below zero."""
    lines = source(spark, sf_dir, "lineitem").join(source(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    measured = lines.select("l_quantity", (F.col("l_extendedprice") - 50 * F.col("p_retailprice")).alias("margin"))
    counts = measured.agg(checks.failing(checks.any_negative(["margin", "l_quantity"])).alias("failed_count"))
    return checks.log_rows(counts, checks.result("NON_NEGATIVE", "ERROR", "")).select("failed_count", "status")


@R.add("dq_duplicates", """
SELECT count(*) AS failed_count, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)""")
def dq_duplicates(spark, sf_dir):
    """How many (order, line number) values occur more than once."""
    found = checks.duplicate_groups(source(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    return checks.log_rows(found, checks.result("DUPLICATES", "ERROR", "")).select("failed_count", "status")


# ---- joins --------------------------------------------------------------------------------------


@R.add("jn_star_inner", with_roles("""
SELECT order_id, order_detail_id, truck_brand_name, country, franchisee_first_name,
       CAST(location_id AS BIGINT) AS location_id, CAST(price AS DOUBLE) AS price
FROM orders_v"""))
def jn_star_inner(spark, sf_dir):
    """The five inner joins of the star; the optional member join adds nothing here."""
    return views.orders_v(roles(spark, sf_dir)).select(
        "order_id", "order_detail_id", "truck_brand_name", "country", "franchisee_first_name", "location_id", "price"
    )


@R.add("jn_star_left_optional", with_roles("""
SELECT h.order_id, c.customer_id, c.first_name
FROM order_header h LEFT JOIN customer_loyalty c ON h.customer_id = c.customer_id"""))
def jn_star_left_optional(spark, sf_dir):
    """Orders keep NULL attributes, and a NULL key, where the buyer is no member."""
    t = roles(spark, sf_dir)
    members = t["customer_loyalty"].select("customer_id", "first_name")
    orders = t["order_header"].select("order_id", F.col("customer_id").alias("buyer_id"))
    return orders.join(members, F.col("buyer_id") == F.col("customer_id"), "left").drop("buyer_id")


@R.add("jn_mn_distinct", with_roles("""
SELECT DISTINCT t.truck_id, t.primary_city, m.truck_brand_name
FROM truck t JOIN menu m ON m.menu_type_id = t.menu_type_id"""))
def jn_mn_distinct(spark, sf_dir):
    """Many-to-many on a type key: both sides distinct first, so the join has no fan-out to undo."""
    t = roles(spark, sf_dir)
    brands = t["menu"].select("menu_type_id", "truck_brand_name").distinct()
    trucks = t["truck"].select("truck_id", "primary_city", "menu_type_id").distinct()
    return trucks.join(brands, "menu_type_id").select("truck_id", "primary_city", "truck_brand_name").distinct()


@R.add("jn_composite_left", with_roles("""
, after AS (SELECT DISTINCT date + 1 AS date, truck_brand_name FROM orders_v)
SELECT CAST(k.date AS VARCHAR) AS date, k.truck_brand_name, count(o.order_id) AS lines,
       count(DISTINCT o.customer_id) AS members
FROM after k
LEFT JOIN orders_v o ON o.truck_brand_name = k.truck_brand_name AND CAST(o.order_ts AS DATE) = k.date
GROUP BY ALL"""))
def jn_composite_left(spark, sf_dir):
    """Left join on a brand and a derived day: what a brand sold on the day after each sale, if anything."""
    per_day = (
        views.orders_v(roles(spark, sf_dir)).groupBy("truck_brand_name", F.to_date("order_ts").alias("date"))
        .agg(F.count("order_id").alias("lines"), F.count_distinct("customer_id").alias("members"))
    )
    after = per_day.select(F.date_add("date", 1).alias("date"), "truck_brand_name")
    return after.join(per_day, ["date", "truck_brand_name"], "left").select(
        "date", "truck_brand_name", F.coalesce("lines", F.lit(0)).alias("lines"),
        F.coalesce("members", F.lit(0)).alias("members"),
    )


@R.add("jn_float_key", with_roles("""
SELECT CAST(l.location_id AS BIGINT) AS location_id, count(*) AS orders, CAST(sum(h.order_total) AS DOUBLE) AS total
FROM order_header h JOIN location l ON h.location_id = l.location_id GROUP BY ALL"""))
def jn_float_key(spark, sf_dir):
    """A floating point key joined to an integer one; orders are added up per key before the join."""
    t = roles(spark, sf_dir)
    visits = t["order_header"].groupBy(views.whole_key(F.col("location_id")).alias("location_id")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("order_total").alias("total")
    )
    return t["location"].select("location_id").join(visits, "location_id")


_DAILY_SQL = ", daily AS (SELECT menu_item_id, date, sum(net_sales) AS sales FROM brand_fact GROUP BY ALL)"

_TRAILING = with_fact(_DAILY_SQL + """
SELECT a.menu_item_id, CAST(a.date AS VARCHAR) AS date, count(b.sales) AS days, CAST(sum(b.sales) AS DOUBLE) AS total
FROM daily a LEFT JOIN daily b ON b.menu_item_id = a.menu_item_id AND b.date BETWEEN a.date - 60 AND a.date - 1
GROUP BY ALL""")


def _daily(spark, sf_dir):
    return _history(spark, sf_dir).groupBy("menu_item_id", "date").agg(F.sum("net_sales").alias("sales"))


@R.add("jn_trailing_range", _TRAILING)
def jn_trailing_range(spark, sf_dir):
    """Self-join on item and the 60 days before, as a range frame over one row per day."""
    return trailing_sums_by_frame(_daily(spark, sf_dir), ["menu_item_id"], "date", "sales")


@R.add("jn_trailing_range_exploded", _TRAILING)
def jn_trailing_range_exploded(spark, sf_dir):
    """The same self-join as an equi join on the days each row reaches."""
    return trailing_sums_by_join(_daily(spark, sf_dir), ["menu_item_id"], "date", "sales")


_SPANS = (1, 60)  # days


def _span_sql(days: int) -> str:
    near = f"b.ts >= a.ts - INTERVAL {days} DAY"
    return f"""count(b.value) FILTER ({near}) AS n_{days}d,
       CAST(sum(CAST(b.value AS DECIMAL(18,2))) FILTER ({near}) AS DOUBLE) AS total_{days}d"""


@R.add("jn_trailing_events", f"""
SELECT a.user_id, strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS ts, {", ".join(_span_sql(n) for n in _SPANS)}
FROM (SELECT DISTINCT user_id, ts FROM events) a LEFT JOIN events b ON b.user_id = a.user_id AND b.ts < a.ts
GROUP BY a.user_id, a.ts""")
def jn_trailing_events(spark, sf_dir):
    """What each user's events of the day and of the 60 days before add up to, at every event, to the microsecond."""
    events = source(spark, sf_dir, "events").select("user_id", "ts", F.col("value").cast("decimal(18,2)").alias("value"))
    return trailing_sums_at(events, ["user_id"], "ts", "value", {f"{n}d": dt.timedelta(days=n) for n in _SPANS})


@R.add("jn_range_events", """
SELECT p.user_id, p.event_id AS purchase_id, s.event_id AS signup_id
FROM events p JOIN events s ON s.user_id = p.user_id AND s.ts >= p.ts - INTERVAL 60 DAY AND s.ts < p.ts
WHERE p.event_type = 'purchase' AND s.event_type = 'signup'""")
def jn_range_events(spark, sf_dir):
    """Purchases and the same user's sign-ups of the 60 days before, by time bins."""
    events = source(spark, sf_dir, "events")

    def of(kind, event, time):
        return events.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(event), F.col("ts").alias(time))

    pairs = trailing_join(
        of("purchase", "purchase_id", "bought"), of("signup", "signup_id", "signed"), ["user_id"], "bought", "signed", dt.timedelta(days=60)
    )
    return pairs.select("user_id", "purchase_id", "signup_id")


# ---- aggregations -------------------------------------------------------------------------------


@R.add("agg_wide_group", with_roles("""
SELECT c.customer_id, c.city, c.country, c.first_name, c.last_name, c.phone_number, c.e_mail,
       count(*) AS orders, CAST(sum(h.order_total) AS DOUBLE) AS total
FROM customer_loyalty c JOIN order_header h ON c.customer_id = h.customer_id GROUP BY ALL"""))
def agg_wide_group(spark, sf_dir):
    t = roles(spark, sf_dir)
    per_buyer = t["order_header"].groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("order_total").alias("total")
    )
    return t["customer_loyalty"].select(*views.MEMBER_KEYS).join(per_buyer, "customer_id").groupBy(*views.MEMBER_KEYS).agg(
        F.sum("orders").alias("orders"), F.sum("total").alias("total")
    )


@R.add("agg_sum_count", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
       CAST(sum(l_quantity) AS BIGINT) AS quantity
FROM lineitem GROUP BY ALL""")
def agg_sum_count(spark, sf_dir):
    return source(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
    )


@R.add("agg_count_distinct", """
SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts
FROM lineitem GROUP BY ALL""")
def agg_count_distinct(spark, sf_dir):
    return source(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts")
    )


@R.add("agg_stats", f"""
SELECT user_id, count(*) AS n, {shown_sql("avg(value)")} AS mean, {shown_sql("stddev_samp(value)")} AS sd,
       {shown_sql("median(value)")} AS median
FROM events GROUP BY ALL""")
def agg_stats(spark, sf_dir):
    """Count, mean, sample deviation and interpolated median; the deviation of one value is NULL."""
    events = source(spark, sf_dir, "events")
    moments = events.groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    middle = group_order_stats(events, ["user_id"], "value", median_dev=False)
    return moments.join(middle, "user_id").select(
        "user_id", "n", *[shown(c).alias(c) for c in ("mean", "sd", "median")]
    )


_MEDIANS = "m AS (SELECT event_type, median(value) AS m FROM events GROUP BY ALL)"


@R.add("agg_mean_abs_dev", f"""
WITH {_MEDIANS}
SELECT event_type, {shown_sql("avg(abs(value - m))")} AS mean_abs_dev FROM events JOIN m USING (event_type) GROUP BY ALL""")
def agg_mean_abs_dev(spark, sf_dir):
    """Mean absolute deviation about the median."""
    stats = group_order_stats(source(spark, sf_dir, "events"), ["event_type"], "value", median_dev=False)
    return stats.select("event_type", shown("mean_abs_dev").alias("mean_abs_dev"))


@R.add("agg_median_abs_dev", f"""
SELECT event_type, {shown_sql("mad(value)")} AS median_abs_dev FROM events GROUP BY ALL""")
def agg_median_abs_dev(spark, sf_dir):
    """Median absolute deviation about the median."""
    stats = group_order_stats(source(spark, sf_dir, "events"), ["event_type"], "value")
    return stats.select("event_type", shown("median_abs_dev").alias("median_abs_dev"))


@R.add("agg_order_stats_banded", f"""
WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS m FROM lineitem GROUP BY ALL)
SELECT l_returnflag, count(*) AS n, {shown_sql("any_value(m)")} AS median,
       {shown_sql("avg(abs(l_extendedprice - m))", 3)} AS mean_abs_dev,
       {shown_sql("median(abs(l_extendedprice - m))")} AS median_abs_dev
FROM lineitem JOIN m USING (l_returnflag) GROUP BY ALL""")
def agg_order_stats_banded(spark, sf_dir):
    """The same statistics of three hot groups."""
    stats = group_order_stats(source(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return stats.select(
        "l_returnflag", "n", shown("median").alias("median"), shown("mean_abs_dev", 3).alias("mean_abs_dev"),
        shown("median_abs_dev").alias("median_abs_dev"),
    )


@R.add("agg_order_stats_digits", f"""
WITH ratios AS (SELECT p_brand, p_retailprice / p_size AS x FROM part),
m AS (SELECT p_brand, median(x) AS m FROM ratios GROUP BY ALL)
SELECT p_brand, count(*) AS n, {shown_sql("any_value(m)", 9)} AS median, {shown_sql("avg(abs(x - m))", 9)} AS mean_abs_dev,
       {shown_sql("median(abs(x - m))", 9)} AS median_abs_dev
FROM ratios JOIN m USING (p_brand) GROUP BY ALL""")
def agg_order_stats_digits(spark, sf_dir):
    """The same of quotients, which use all digits of a double."""
    ratios = source(spark, sf_dir, "part").select("p_brand", (F.col("p_retailprice") / F.col("p_size")).alias("x"))
    stats = group_order_stats(ratios, ["p_brand"], "x")
    return stats.select("p_brand", "n", *[shown(c, 9).alias(c) for c in ("median", "mean_abs_dev", "median_abs_dev")])


@R.add("agg_array_distinct", with_roles("""
SELECT customer_id, list_aggregate(list_sort(list(DISTINCT CAST(location_id AS BIGINT))), 'string_agg', ',') AS places
FROM order_header GROUP BY ALL"""))
def agg_array_distinct(spark, sf_dir):
    """Distinct values as an array (in number order here, so that it compares)."""
    header = roles(spark, sf_dir)["order_header"]
    sets = header.groupBy("customer_id").agg(F.collect_set(views.whole_key(F.col("location_id"))).alias("s"))
    return sets.select("customer_id", F.array_join(F.sort_array("s").cast("array<string>"), ",").alias("places"))


@R.add("agg_array_distinct_sorted", """
SELECT p_brand, list_aggregate(list_sort(list(DISTINCT CAST(p_size AS VARCHAR))), 'string_agg', ',') AS sizes
FROM part GROUP BY ALL""")
def agg_array_distinct_sorted(spark, sf_dir):
    """Distinct texts in text order."""
    return source(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.array_join(F.sort_array(F.collect_set(F.col("p_size").cast("string"))), ",").alias("sizes")
    )


@R.add("agg_ratio_guarded", """
SELECT o_orderpriority, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)
         / nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0), 4) AS ratio
FROM orders GROUP BY ALL""")
def agg_ratio_guarded(spark, sf_dir):
    """A ratio of aggregates that is NULL where the divisor is zero."""
    return source(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.round(
            safe_divide(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), F.count_if(F.col("o_orderstatus") == "F")), 4
        ).alias("ratio")
    )


# ---- trailing windows over the whole history ------------------------------------------------------


@R.add("win_trailing_mean_sd", with_fact(f"""
SELECT a.menu_item_id, CAST(a.date AS VARCHAR) AS date, count(b.net_sales) AS n,
       {shown_sql("avg(CAST(b.net_sales AS DOUBLE))")} AS mean,
       {shown_sql("stddev_samp(CAST(b.net_sales AS DOUBLE))", 3)} AS sd
FROM (SELECT DISTINCT menu_item_id, date FROM brand_fact) a LEFT JOIN brand_fact b
  ON b.menu_item_id = a.menu_item_id AND b.date BETWEEN a.date - 60 AND a.date - 1
GROUP BY ALL"""))
def win_trailing_mean_sd(spark, sf_dir):
    """Mean, sample deviation and count of the 60 days before, pooled over locations."""
    daily = daily_moments(_history(spark, sf_dir), ["menu_item_id"], "date", "net_sales")
    return trailing_moments(daily, ["menu_item_id"], "date").select(
        "menu_item_id", "date", "n", shown("mean").alias("mean"),
        shown(sample_sd(F.col("m2"), F.col("n")), 3).alias("sd"),
    )


def _trailing_order(spark, sf_dir, median_dev):
    rows = stored(_history(spark, sf_dir).select("menu_item_id", "date", units(F.col("net_sales"), 2).alias("v")))
    last, first, largest, middle = rows.agg(
        F.max("date"), F.min("date"), F.max("v"), F.percentile_approx("v", [0.1, 0.9], 1000),
    ).first()
    in_a_day = rows.groupBy("menu_item_id", "date").count().agg(F.max("count")).first()[0] or 0
    bits = band_bits(largest, middle and middle[1] - middle[0], 60 * in_a_day)
    stats = trailing_order_stats(
        rows, ["menu_item_id"], "date", first, last, F.lit(bits), F.lit(100.0), median_dev=median_dev,
    )
    return rows.select("menu_item_id", "date").distinct().join(stats, ["menu_item_id", "date"])


_FRAMES = """
, frames AS (
  SELECT a.menu_item_id, a.date, CAST(b.net_sales AS DOUBLE) AS x
  FROM (SELECT DISTINCT menu_item_id, date FROM brand_fact) a JOIN brand_fact b
    ON b.menu_item_id = a.menu_item_id AND b.date BETWEEN a.date - 60 AND a.date - 1),
middle AS (SELECT menu_item_id, date, median(x) AS m FROM frames GROUP BY ALL)"""


@R.add("win_trailing_median", with_fact(_FRAMES + f"""
SELECT menu_item_id, CAST(date AS VARCHAR) AS date, {shown_sql("m")} AS median FROM middle"""))
def win_trailing_median(spark, sf_dir):
    """Median of the 60 days before."""
    return _trailing_order(spark, sf_dir, False).select("menu_item_id", "date", shown("median").alias("median"))


@R.add("win_trailing_mean_abs_dev", with_fact(_FRAMES + f"""
SELECT menu_item_id, CAST(date AS VARCHAR) AS date, {shown_sql("avg(abs(x - m))", 3)} AS mean_abs_dev
FROM frames JOIN middle USING (menu_item_id, date) GROUP BY ALL"""))
def win_trailing_mean_abs_dev(spark, sf_dir):
    """Mean absolute deviation of the 60 days before about their median."""
    return _trailing_order(spark, sf_dir, False).select(
        "menu_item_id", "date", shown("mean_abs_dev", 3).alias("mean_abs_dev")
    )


@R.add("win_trailing_median_abs_dev", with_fact(_FRAMES + f"""
SELECT menu_item_id, CAST(date AS VARCHAR) AS date, {shown_sql("median(abs(x - m))", 3)} AS median_abs_dev
FROM frames JOIN middle USING (menu_item_id, date) GROUP BY ALL"""))
def win_trailing_median_abs_dev(spark, sf_dir):
    """Median absolute deviation of the 60 days before."""
    return _trailing_order(spark, sf_dir, True).select(
        "menu_item_id", "date", shown("median_abs_dev", 3).alias("median_abs_dev")
    )


# ---- top-k and limits -----------------------------------------------------------------------------


@R.add("topk_by_key", with_roles("""
SELECT CAST(customer_id AS VARCHAR) AS customer_id, total FROM (
  SELECT customer_id, CAST(sum(order_total) AS DOUBLE) AS total FROM order_header
  GROUP BY customer_id ORDER BY customer_id LIMIT 100)"""))
def topk_by_key(spark, sf_dir):
    """The first hundred customers by number, shown as text."""
    totals = roles(spark, sf_dir)["order_header"].groupBy("customer_id").agg(F.sum("order_total").alias("total"))
    return totals.orderBy("customer_id").limit(100).withColumn(
        "customer_id", F.col("customer_id").cast("string")
    )


@R.add("limit_preview", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey, o_custkey LIMIT 200""")
def limit_preview(spark, sf_dir):
    """The first 200 rows."""
    return lineage.preview(
        source(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey", "o_custkey"]
    )


# ---- set operations -------------------------------------------------------------------------------

_METRICS = with_fact("""
SELECT CAST(date AS VARCHAR) AS date, menu_item_id, country, location_id, 'NET_SALES' AS metric_name,
       CAST(net_sales AS DOUBLE) AS metric_value FROM brand_fact
UNION ALL
SELECT CAST(date AS VARCHAR), menu_item_id, country, location_id, 'QUANTITY', CAST(quantity AS DOUBLE) FROM brand_fact""")


@R.add("set_union_all_metrics", _METRICS)
def set_union_all_metrics(spark, sf_dir):
    """Two metric branches over the same rows, one after the other; the rows are computed once."""
    fact = stored(_history(spark, sf_dir).select("date", "menu_item_id", "country", "location_id", "net_sales", "quantity"))

    def branch(name, column):
        return fact.select(
            "date", "menu_item_id", "country", "location_id", F.lit(name).alias("metric_name"),
            F.col(column).cast("decimal(38,2)").alias("metric_value"),
        )

    return branch("NET_SALES", "net_sales").unionByName(branch("QUANTITY", "quantity"))


@R.add("set_unpivot_metrics", _METRICS)
def set_unpivot_metrics(spark, sf_dir):
    """The same from one scan."""
    return (
        _history(spark, sf_dir)
        .select("date", "menu_item_id", "country", "location_id", F.col("net_sales").cast("decimal(38,2)").alias("NET_SALES"),
                F.col("quantity").cast("decimal(38,2)").alias("QUANTITY"))
        .unpivot(["date", "menu_item_id", "country", "location_id"], ["NET_SALES", "QUANTITY"], "metric_name", "metric_value")
    )


@R.add("latest_order_day", f"SELECT CAST({AS_OF} AS VARCHAR) AS as_of")
def latest_order_day(spark, sf_dir):
    """The as-of day the windows below hang on."""
    return roles(spark, sf_dir)["order_header"].agg(F.to_date(F.max("order_ts")).alias("as_of"))

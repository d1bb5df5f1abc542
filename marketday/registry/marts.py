"""Registered queries: the sales marts, their checks, anomalies and the daily run."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketday.operators.rebuild import cutoff_date, in_window, rebuild_partitions, rebuilt
from marketday.operators.snapshots import SnapshotTable
from marketday.plans import anomalies, marts, quality, views
from marketday.plans.daily_run import DailyRun
from marketday.registry.base import AS_OF, Registry, brand_fact, roles, shown, shown_sql, stored, with_fact, with_roles
from marketday.session import scratch_path
from marketday.sources.standin import RoleTables, latest_order_date
from marketday.streaming.facts import SOURCES, FactFeed

R = Registry()

_FACT_OUT = """CAST(date AS VARCHAR) AS date, menu_item_id, menu_item_name, truck_brand_name, country, location_id,
       orders_count, order_lines, quantity, CAST(gross_sales AS DOUBLE) AS gross_sales, CAST(net_sales AS DOUBLE) AS net_sales"""


def _fact(spark, sf_dir, days_back):
    t = roles(spark, sf_dir)
    as_of = latest_order_date(t)
    return marts.build_fact(t, as_of, days_back), as_of, t


@R.add("p_fact_daily", with_fact(f"SELECT {_FACT_OUT} FROM fact WHERE date >= {AS_OF} - 7"))
def p_fact_daily(spark, sf_dir):
    """Daily item sales of the last seven days."""
    return _fact(spark, sf_dir, marts.DEFAULT_DAYS)[0]


@R.add("p_fact_daily_history", with_fact(f"SELECT {_FACT_OUT} FROM fact"))
def p_fact_daily_history(spark, sf_dir):
    """Daily item sales of all days, as a first load builds them."""
    return marts.daily_item_sales(views.orders_v(roles(spark, sf_dir)))


# Cents divided by orders, rounded half up in whole numbers.
_AOV = "CAST((2 * CAST(sum(net_sales) * 100 AS BIGINT) + sum(orders_count)) // (2 * nullif(sum(orders_count), 0)) AS DOUBLE) / 100"


def _kpi_sql(days: str, per_line: bool) -> str:
    times = "greatest(coalesce(max(lines), 1), 1)" if per_line else "1"
    return with_fact(f"""
, buyers AS (SELECT date, truck_brand_name, count(*) AS lines, count(DISTINCT customer_id) AS customers
             FROM orders_v GROUP BY ALL)
SELECT CAST(f.date AS VARCHAR) AS date, f.truck_brand_name, CAST(sum(orders_count) * {times} AS BIGINT) AS total_orders,
       CAST(sum(order_lines) * {times} AS BIGINT) AS total_order_lines,
       CAST(sum(quantity) * {times} AS BIGINT) AS total_quantity,
       CAST(sum(net_sales) * {times} AS DOUBLE) AS total_sales,
       {_AOV} AS avg_order_value,
       coalesce(max(customers), 0) AS unique_customers
FROM fact f LEFT JOIN buyers b ON b.date = f.date AND b.truck_brand_name = f.truck_brand_name {days}
GROUP BY f.date, f.truck_brand_name""")


_LITERAL_KPI = with_fact(f"""
, lines AS (SELECT date, truck_brand_name, customer_id FROM orders_v)
SELECT CAST(date AS VARCHAR) AS date, truck_brand_name, CAST(sum(orders_count) AS BIGINT) AS total_orders,
       CAST(sum(order_lines) AS BIGINT) AS total_order_lines, CAST(sum(quantity) AS BIGINT) AS total_quantity,
       CAST(sum(net_sales) AS DOUBLE) AS total_sales, {_AOV} AS avg_order_value,
       count(DISTINCT customer_id) AS unique_customers
FROM fact LEFT JOIN lines USING (date, truck_brand_name) WHERE date >= {AS_OF} - 7
GROUP BY date, truck_brand_name""")


def _narrow(orders):
    """What facts and KPIs need of the order view, written once: one star join serves both sides of the KPI."""
    return stored(orders.select(
        "order_id", "order_ts", "menu_item_id", "menu_item_name", "truck_brand_name", "country", "location_id", "customer_id", "quantity", "price"
    ))


def _kpi(spark, sf_dir, per_line):
    t = roles(spark, sf_dir)
    as_of = latest_order_date(t)
    orders = _narrow(marts.window_orders(t, as_of, marts.DEFAULT_DAYS))
    return marts.build_kpi(marts.daily_item_sales(orders), orders, as_of, marts.DEFAULT_DAYS, per_line)


@R.add("p_kpi_brand", _kpi_sql(f"WHERE f.date >= {AS_OF} - 7", False))
def p_kpi_brand(spark, sf_dir):
    """Brand KPIs of the last seven days; totals are the facts' own."""
    return _kpi(spark, sf_dir, False)


@R.add("p_kpi_brand_as_written", _LITERAL_KPI)
def p_kpi_brand_as_written(spark, sf_dir):
    """The same with the totals of the literal many-to-many join."""
    return _kpi(spark, sf_dir, True)


@R.add("p_kpi_brand_history", _kpi_sql("", False))
def p_kpi_brand_history(spark, sf_dir):
    """Brand KPIs of all days."""
    orders = _narrow(views.orders_v(roles(spark, sf_dir)))
    return marts.brand_kpi(marts.daily_item_sales(orders), orders)


# Every 50th item lacks its key in one location, every 70th has a negative quantity, every 90th appears twice.
_SPOILT = """
, spoilt AS (
  SELECT date, CASE WHEN CAST(menu_item_id AS BIGINT) % 50 = 0 AND location_id = '3' THEN NULL ELSE menu_item_id END AS menu_item_id,
         menu_item_name, truck_brand_name, country, location_id, orders_count, order_lines,
         CASE WHEN CAST(menu_item_id AS BIGINT) % 70 = 0 THEN -quantity ELSE quantity END AS quantity, gross_sales, net_sales
  FROM fact
  UNION ALL SELECT * FROM fact WHERE CAST(menu_item_id AS BIGINT) % 90 = 1)"""


@R.add("p_dq_report", with_fact(_SPOILT + """
, dup AS (SELECT count(*) AS n FROM (SELECT 1 FROM spoilt GROUP BY date, menu_item_id, location_id HAVING count(*) > 1)),
bad AS (SELECT * FROM spoilt WHERE menu_item_id IS NULL OR location_id IS NULL),
first_rows AS (SELECT * FROM bad ORDER BY date, menu_item_id NULLS FIRST, menu_item_name, truck_brand_name, country, location_id LIMIT 10),
shown AS (SELECT '{"sample_rows":[' || string_agg('{"date":"' || date || '","menu_item_name":"' || menu_item_name || '","truck_brand_name":"'
            || truck_brand_name || '","country":"' || country || '","location_id":"' || location_id || '","orders_count":' || orders_count
            || ',"order_lines":' || order_lines || ',"quantity":' || quantity || ',"gross_sales":' || gross_sales || ',"net_sales":' || net_sales
            || '}', ',' ORDER BY date, menu_item_name, truck_brand_name, country, location_id) || ']}' AS rows FROM first_rows)
SELECT 'FACT_NULL_KEYS' AS check_name, 'ERROR' AS severity, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, n AS failed_count,
       rows AS sample_rows, 'menu_item_id/location_id should not be NULL' AS notes FROM (SELECT count(*) AS n FROM bad), shown
UNION ALL SELECT 'FACT_NON_NEGATIVE', 'ERROR', CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END, n, NULL, 'quantity, gross_sales, net_sales must be >= 0'
          FROM (SELECT count(*) AS n FROM spoilt WHERE quantity < 0 OR gross_sales < 0 OR net_sales < 0)
UNION ALL SELECT 'FACT_DUPLICATES', 'ERROR', CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END, n, NULL,
       'Duplicate rows at (date, menu_item_id, location_id)' FROM dup"""))
def p_dq_report(spark, sf_dir):
    """The three checks over the facts of all days, with failures put in."""
    t = roles(spark, sf_dir)
    fact = marts.daily_item_sales(views.orders_v(t))
    item = F.col("menu_item_id").cast("bigint")
    spoilt = stored(
        fact.withColumn("quantity", F.when(item % 70 == 0, -F.col("quantity")).otherwise(F.col("quantity")))
        .withColumn("copies", F.when(item % 90 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
        .withColumn("menu_item_id", F.when((item % 50 == 0) & (F.col("location_id") == "3"), None).otherwise(F.col("menu_item_id")))
        .withColumn("copies", F.explode("copies")).drop("copies")
    )
    return quality.fact_checks(spoilt, dt.date(1900, 1, 1), 0)


def _anomaly_sql(as_written: bool, table: str = "brand_fact") -> str:
    # As written, the scored rows join the history (each history row once per scored row of the item
    # and day) and the spread is the mean deviation; otherwise each history row counts once.
    scored = "SELECT date, menu_item_id" if as_written else "SELECT DISTINCT date, menu_item_id"
    spread = "avg(abs(x - m))" if as_written else "median(abs(x - m))"
    return with_fact(f"""
, base AS (SELECT date, menu_item_id, truck_brand_name, country, location_id, 'NET_SALES' AS metric_name,
                  CAST(net_sales AS DOUBLE) AS x FROM {table} WHERE date >= {AS_OF} - 90
           UNION ALL
           SELECT date, menu_item_id, truck_brand_name, country, location_id, 'QUANTITY', CAST(quantity AS DOUBLE)
           FROM {table} WHERE date >= {AS_OF} - 90),
recent AS ({scored}, metric_name FROM base WHERE date >= {AS_OF} - 30),
frames AS (SELECT r.date, r.menu_item_id, r.metric_name, b.x FROM recent r JOIN base b
           ON b.menu_item_id = r.menu_item_id AND b.metric_name = r.metric_name AND b.date BETWEEN r.date - 60 AND r.date - 1),
stats AS (SELECT date, menu_item_id, metric_name, avg(x) AS mean, stddev_samp(x) AS sd, median(x) AS m
          FROM frames GROUP BY ALL),
spreads AS (SELECT date, menu_item_id, metric_name, {spread} AS spread
            FROM frames JOIN stats USING (date, menu_item_id, metric_name) GROUP BY ALL),
scores AS (SELECT b.*, (x - mean) / nullif(sd, 0) AS z, (x - m) / nullif(1.4826 * spread, 0) AS rz
           FROM base b LEFT JOIN stats USING (date, menu_item_id, metric_name)
           LEFT JOIN spreads USING (date, menu_item_id, metric_name) WHERE b.date >= {AS_OF} - 30)
SELECT CAST(date AS VARCHAR) AS date, 'ITEM' AS grain, menu_item_id AS id, metric_name, x AS metric_value,
       {shown_sql("z")} AS zscore, {shown_sql("rz")} AS robust_zscore,
       abs(coalesce(z, 0)) >= 3 OR abs(coalesce(rz, 0)) >= 3 AS anomaly_flag,
       '{{"brand":"' || truck_brand_name || '","country":"' || country || '","location":"' || location_id || '"}}' AS context
FROM scores""")


def _anomalies(spark, sf_dir, as_written, days=anomalies.DEFAULT_DAYS):
    fact, as_of, _ = _fact(spark, sf_dir, days + anomalies.HISTORY_DAYS)
    found = anomalies.detect_anomalies(stored(brand_fact(fact)), as_of, days, as_written)
    return found.withColumn("zscore", shown("zscore")).withColumn("robust_zscore", shown("robust_zscore"))


@R.add("p_anomalies", _anomaly_sql(False))
def p_anomalies(spark, sf_dir):
    """Scores of the last 30 days against 60 days of history, brand as the item."""
    return _anomalies(spark, sf_dir, False)


@R.add("p_anomalies_as_written", _anomaly_sql(True))
def p_anomalies_as_written(spark, sf_dir):
    """The same by the literal definition: mean deviation, history repeated per scored row."""
    return _anomalies(spark, sf_dir, True)


_REBUILT = with_fact(f"""
SELECT CAST(date AS VARCHAR) AS date, CAST(sum(order_lines) AS BIGINT) AS order_lines,
       CAST(sum(CASE WHEN date >= {AS_OF} - 30 AND date < {AS_OF} - 7 THEN 2 ELSE 1 END * net_sales) AS DOUBLE) AS net_sales
FROM fact GROUP BY ALL""")


def _stale(spark, sf_dir, grain="day"):
    """A mart whose last 30 days are wrong (doubled), and the right rows of the last 7 (and their weeks)."""
    t = roles(spark, sf_dir)
    as_of = latest_order_date(t)
    keep = ["date", "menu_item_id", "location_id", "order_lines", "net_sales"]
    fact = stored(marts.daily_item_sales(views.orders_v(t)).select(*keep))
    wrong = F.when(in_window(F.col("date"), cutoff_date(as_of, 30)), 2).otherwise(1)
    target = fact.withColumn("net_sales", (F.col("net_sales") * wrong).cast("decimal(38,2)"))
    cutoff = cutoff_date(as_of, marts.DEFAULT_DAYS)
    if grain == "week":
        cutoff -= dt.timedelta(days=cutoff.weekday())
        week = F.trunc("date", "week")
        fact, target = fact.withColumn("date", week), target.withColumn("date", week)
    return target, fact.filter(in_window(F.col("date"), cutoff)), cutoff


def _per_day(df):
    return df.groupBy("date").agg(F.sum("order_lines").alias("order_lines"), F.sum("net_sales").alias("net_sales"))


@R.add("rebuild_window", _REBUILT)
def rebuild_window(spark, sf_dir):
    """The trailing week of a mart replaced; older days stay as they were."""
    return _per_day(rebuilt(*_stale(spark, sf_dir)))


@R.add("rebuild_window_stored", with_fact(f"""
SELECT CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) AS date, CAST(sum(order_lines) AS BIGINT) AS order_lines,
       CAST(sum(CASE WHEN date >= {AS_OF} - 30 AND date < date_trunc('week', {AS_OF} - 7) THEN 2 ELSE 1 END * net_sales) AS DOUBLE) AS net_sales
FROM fact GROUP BY ALL"""))
def rebuild_window_stored(spark, sf_dir):
    """The same on a stored table, here one partition a week: only the newest partitions are written."""
    target, fresh, cutoff = _stale(spark, sf_dir, "week")
    path = scratch_path(spark, "stored-mart")
    target.repartition("date").write.partitionBy("date").parquet(path)
    rebuild_partitions(fresh, path, cutoff)
    return _per_day(spark.read.schema(target.schema).parquet(path))


@R.add("rebuild_window_snapshot", _REBUILT)
def rebuild_window_snapshot(spark, sf_dir):
    """The trailing week of a table of versions: the newest version after the rebuild is committed."""
    target, fresh, cutoff = _stale(spark, sf_dir)
    table = SnapshotTable(spark, scratch_path(spark, "versions"), target.schema)
    table.rebuild(target, None)
    table.rebuild(fresh, cutoff)
    return _per_day(table.read())


@R.add("rebuild_window_before", with_fact(f"""
SELECT CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) AS date, CAST(sum(order_lines) AS BIGINT) AS order_lines,
       CAST(sum(CASE WHEN date >= {AS_OF} - 30 THEN 2 ELSE 1 END * net_sales) AS DOUBLE) AS net_sales
FROM fact GROUP BY ALL"""))
def rebuild_window_before(spark, sf_dir):
    """What a reader that started before a rebuild goes on seeing: the version it opened; one folder a week."""
    target, fresh, cutoff = _stale(spark, sf_dir, "week")
    table = SnapshotTable(spark, scratch_path(spark, "versions"), target.schema)
    table.rebuild(target, None)
    opened = table.read()
    table.rebuild(fresh, cutoff)
    return _per_day(opened)


@R.add("p_fact_incremental", with_fact(f"SELECT {_FACT_OUT} FROM fact"))
def p_fact_incremental(spark, sf_dir):
    """Facts of all days from a feed that ran after each of three drops.

    History but for late lines of its last month; lines of the newest week ahead of their headers; what is left.
    """
    t = roles(spark, sf_dir)
    as_of = latest_order_date(t)
    header, lines = t["order_header"], t["order_detail"]

    def split(days):
        return (F.col("order_ts") >= F.lit(cutoff_date(as_of, days))) | F.col("order_ts").isNull()

    newest = header.filter(split(7)).select("order_id")
    late = header.filter(split(30) & ~split(7) & (F.col("order_id") % 3 == 0)).select("order_id")
    later = newest.unionByName(late)
    drops = (
        {"order_header": header.filter(~split(7)), "order_detail": lines.join(later, "order_id", "left_anti")},
        {"order_detail": lines.join(newest, "order_id", "left_semi")},
        {"order_header": header.filter(split(7)), "order_detail": lines.join(late, "order_id", "left_semi")},
    )
    inbox = scratch_path(spark, "inbox")
    feed = FactFeed(spark, t, inbox, scratch_path(spark, "fed-marts"))
    for source in SOURCES:  # streams read folders that are there
        t[source].limit(0).write.csv(f"{inbox}/{source}")
    for drop in drops:
        for source, rows in drop.items():
            rows = rows.select(t[source].columns)
            rows.write.mode("append").options(header="false", escape='"', emptyValue="", compression="gzip").csv(f"{inbox}/{source}")
        feed.run()
    return feed.mart.read().drop("last_updated_at")


_WINDOWS = (7, 30, 365)


@R.add("kpi_distinct_orders", with_roles(" UNION ALL ".join(
    f"""SELECT CAST({n} AS BIGINT) AS days_back, truck_brand_name, count(DISTINCT order_id) AS distinct_orders
    FROM orders_v WHERE date >= {AS_OF} - {n} GROUP BY truck_brand_name
    UNION ALL SELECT {n}, 'all brands', count(DISTINCT order_id) FROM orders_v WHERE date >= {AS_OF} - {n} HAVING count(*) > 0""" for n in _WINDOWS)))
def kpi_distinct_orders(spark, sf_dir):
    """Distinct orders of several windows, by brand and over all, from the stored daily bitmaps: the orders are scanned once."""
    t = roles(spark, sf_dir)
    as_of = latest_order_date(t)
    kept = stored(marts.order_bitmaps(marts.window_orders(t, as_of, max(_WINDOWS))))
    out = []
    for n in _WINDOWS:
        cutoff = cutoff_date(as_of, n)
        by_brand = marts.distinct_orders(kept, cutoff)
        overall = marts.distinct_orders(kept, cutoff, ()).select(F.lit("all brands").alias("truck_brand_name"), "distinct_orders")
        out.append(by_brand.unionByName(overall.filter("distinct_orders > 0")).withColumn("days_back", F.lit(n)))
    return reduce(DataFrame.unionByName, out)


@R.add("p_daily_run", with_fact(f"""
, week AS (SELECT * FROM fact WHERE date >= {AS_OF} - 7)
SELECT 'build_fact' AS step, true AS success, count(*) AS rows_affected, '' AS error,
       'fact_daily_item_sales built for last 7 days' AS message FROM week
UNION ALL SELECT 'build_kpi', true, count(*), '', 'kpi_daily_brand built for last 7 days'
          FROM (SELECT DISTINCT date, truck_brand_name FROM week)
UNION ALL SELECT 'run_checks', true, 3, '', 'DQ checks executed for last 7 days'
UNION ALL SELECT 'detect', true, 2 * count(*), '', 'Anomalies detected for last 30 days' FROM week"""))
def p_daily_run(spark, sf_dir):
    """The whole daily run on an empty mart folder; its log."""
    t = roles(spark, sf_dir)
    run = DailyRun(spark, t, scratch_path(spark, "marts"), latest_order_date(t))
    return run.run().drop("run_ts")


# ---- the daily run on a filled mart: 90 days first, then late lines arrive, then the last 7 days again --------

_LATE = "order_id % 10 = 3"


def _late(sql: str) -> str:
    """An oracle query whose order lines are those that the two runs have seen: late lines count in the last week only."""
    seen = f"FROM orders_v WHERE date >= {AS_OF} - 90 AND (date >= {AS_OF} - 7 OR NOT ({_LATE})) GROUP BY ALL"
    return sql.replace("FROM orders_v GROUP BY ALL", seen)


def _two_runs(spark, sf_dir):
    t = roles(spark, sf_dir)
    as_of = latest_order_date(t)
    root = scratch_path(spark, "marts")
    early = RoleTables(spark, sf_dir)
    early["order_detail"] = t["order_detail"].filter(f"NOT ({_LATE})")
    run = DailyRun(spark, early, root, as_of)
    run.run(90)
    run.tables = t  # the same job, after the late lines have arrived
    run.run(7)
    return run


@R.add("p_daily_run_fact", _late(with_fact(f"SELECT {_FACT_OUT} FROM fact")))
def p_daily_run_fact(spark, sf_dir):
    """The fact table after both runs."""
    return _two_runs(spark, sf_dir).mart("fact_daily_item_sales").drop("last_updated_at")


@R.add("p_daily_run_kpi", _late(_kpi_sql("", False)))
def p_daily_run_kpi(spark, sf_dir):
    """The brand KPIs after both runs."""
    return _two_runs(spark, sf_dir).mart("kpi_daily_brand").drop("last_updated_at")


def _duplicates_sql(lines: str) -> str:
    keys = "date, menu_item_id, menu_item_name, truck_brand_name, country, location_id"
    return f"""(SELECT count(*) FROM (SELECT 1 FROM (SELECT DISTINCT {keys} FROM orders_v WHERE {lines})
               GROUP BY date, menu_item_id, location_id HAVING count(*) > 1))"""


@R.add("p_daily_run_checks", with_roles(f"""
, runs AS (SELECT {_duplicates_sql(f"date >= {AS_OF} - 90 AND NOT ({_LATE})")} AS n
           UNION ALL SELECT {_duplicates_sql(f"date >= {AS_OF} - 7")})
SELECT 'FACT_DUPLICATES' AS check_name, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, n AS failed_count, NULL AS sample_rows FROM runs
UNION ALL SELECT 'FACT_NULL_KEYS', 'PASS', 0, '{{"sample_rows":[]}}' FROM runs
UNION ALL SELECT 'FACT_NON_NEGATIVE', 'PASS', 0, NULL FROM runs"""))
def p_daily_run_checks(spark, sf_dir):
    """The log of the checks of both runs; p_dq_report shows them failing."""
    return _two_runs(spark, sf_dir).mart("dq_results").select("check_name", "status", "failed_count", "sample_rows")


@R.add("p_daily_run_anomalies", _late(_anomaly_sql(False, "fact")))
def p_daily_run_anomalies(spark, sf_dir):
    """The anomalies of the last 30 days after both runs, by menu item and location as the marts hold them."""
    found = _two_runs(spark, sf_dir).recent("sales_anomalies", anomalies.DEFAULT_DAYS).drop("detected_at")
    return found.withColumn("zscore", shown("zscore")).withColumn("robust_zscore", shown("robust_zscore"))

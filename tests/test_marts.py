import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketday.operators.rebuild import rebuild_partitions, rebuilt
from marketday.plans import anomalies, marts, quality
from marketday.plans.daily_run import DailyRun, read_mart
from marketday.session import scratch_path
from marketday.sources.standin import RoleTables, latest_order_date

FACT = """date date, menu_item_id string, menu_item_name string, truck_brand_name string, country string,
    location_id string, orders_count bigint, order_lines bigint, quantity bigint,
    gross_sales decimal(38,2), net_sales decimal(38,2)"""
D = dt.date(2024, 3, 10)


def fact_row(day, item="1", brand="B", location="L", quantity=1, sales=1, orders=1, lines=1):
    money = None if sales is None else Decimal(str(sales))
    return (day, item, "name", brand, "C", location, orders, lines, quantity, money, money)


def facts(spark, rows):
    return spark.createDataFrame(rows, FACT)


# ---- brand KPIs: totals of the facts, or of the literal many-to-many join ------------------------


def kpi(spark, per_line):
    fact = facts(spark, [fact_row(D, "1", sales=10), fact_row(D, "2", sales=20), fact_row(D, "3", "quiet", sales=5)])
    orders = spark.createDataFrame(
        [(dt.datetime(2024, 3, 10, 9), "B", 1), (dt.datetime(2024, 3, 10, 10), "B", 1), (dt.datetime(2024, 3, 10, 11), "B", None)],
        "order_ts timestamp_ntz, truck_brand_name string, customer_id bigint",
    )
    return {r["truck_brand_name"]: r for r in marts.brand_kpi(fact, orders, per_line).collect()}


def test_kpi_totals_are_the_facts_own(spark):
    got = kpi(spark, False)
    assert (got["B"]["total_sales"], got["B"]["total_orders"], got["B"]["avg_order_value"]) == (30, 2, 15)
    assert got["B"]["unique_customers"] == 1
    assert (got["quiet"]["total_sales"], got["quiet"]["unique_customers"]) == (5, 0)


def test_kpi_of_the_literal_join_counts_every_fact_once_per_line(spark):
    got = kpi(spark, True)
    assert (got["B"]["total_sales"], got["B"]["total_orders"], got["B"]["avg_order_value"]) == (90, 6, 15)
    assert (got["quiet"]["total_sales"], got["quiet"]["total_orders"]) == (5, 1)


def test_order_value_is_null_without_orders_and_rounds_half_up(spark):
    fact = facts(spark, [fact_row(D, "1", "none", sales=10, orders=0), fact_row(D, "2", "half", sales="194876.49", orders=6)])
    orders = spark.createDataFrame([], "order_ts timestamp_ntz, truck_brand_name string, customer_id bigint")
    got = {r["truck_brand_name"]: r["avg_order_value"] for r in marts.brand_kpi(fact, orders).collect()}
    assert got == {"none": None, "half": Decimal("32479.42")}


# ---- rebuild of the trailing window ---------------------------------------------------------------


def day_rows(df):
    return sorted(((r["date"], r["v"]) for r in df.collect()), key=str)


def test_a_day_without_fresh_rows_is_emptied(spark):
    target = spark.createDataFrame(
        [(D - dt.timedelta(days=9), 1), (D - dt.timedelta(days=1), 2), (D, 3), (None, 4)], "date date, v int"
    )
    fresh = spark.createDataFrame([(D, 30), (D + dt.timedelta(days=2), 50)], "date date, v int")
    cutoff = D - dt.timedelta(days=7)
    want = [(D - dt.timedelta(days=9), 1), (D, 30), (D + dt.timedelta(days=2), 50), (None, 4)]
    assert day_rows(rebuilt(target, fresh, cutoff)) == sorted(want, key=str)

    path = scratch_path(spark, "rebuild")
    target.write.partitionBy("date").parquet(path)
    for _ in range(2):  # running it again changes nothing
        assert rebuild_partitions(fresh, path, cutoff) == 2
        assert day_rows(spark.read.schema("v int, date date").parquet(path)) == sorted(want, key=str)


def test_rebuild_starts_from_nothing_and_may_read_its_own_target(spark):
    path = scratch_path(spark, "rebuild")
    rows = spark.createDataFrame([(D, 1), (D, 2)], "date date, v int")
    assert rebuild_partitions(rows, path, D) == 2
    stored = spark.read.schema("v int, date date").parquet(path)
    assert rebuild_partitions(stored.withColumn("v", F.col("v") + 1), path, D) == 2
    assert day_rows(spark.read.schema("v int, date date").parquet(path)) == [(D, 2), (D, 3)]


def test_older_partitions_are_not_written(spark):
    path = scratch_path(spark, "rebuild")
    old = D - dt.timedelta(days=30)
    spark.createDataFrame([(old, 1), (D, 2)], "date date, v int").write.partitionBy("date").parquet(path)

    def files(day):
        found = spark.read.format("binaryFile").load(f"{path}/date={day}/*.parquet").select("path", "modificationTime")
        return sorted(map(tuple, found.collect()))

    before = files(old)
    rebuild_partitions(spark.createDataFrame([(D, 5)], "date date, v int"), path, D)
    assert files(old) == before


# ---- checks ---------------------------------------------------------------------------------------


def report(spark, rows, days_back=7):
    return {r["check_name"]: r for r in quality.fact_checks(facts(spark, rows), D, days_back).collect()}


def test_checks_on_clean_facts(spark):
    got = report(spark, [fact_row(D), fact_row(D, "2")])
    assert {k: (r["status"], r["failed_count"]) for k, r in got.items()} == {
        "FACT_NULL_KEYS": ("PASS", 0), "FACT_NON_NEGATIVE": ("PASS", 0), "FACT_DUPLICATES": ("PASS", 0)
    }
    assert json.loads(got["FACT_NULL_KEYS"]["sample_rows"]) == {"sample_rows": []}


def test_null_keys_are_counted_and_sampled_without_their_null_fields(spark):
    got = report(spark, [fact_row(D, None), fact_row(D, "1", location=None), fact_row(D)])["FACT_NULL_KEYS"]
    assert (got["status"], got["failed_count"], got["severity"]) == ("FAIL", 2, "ERROR")
    sample = json.loads(got["sample_rows"])["sample_rows"]
    assert len(sample) == 2
    assert "menu_item_id" not in sample[0] and "location_id" not in sample[1]


def test_sample_is_at_most_ten(spark):
    got = report(spark, [fact_row(D, None, location=str(i)) for i in range(25)])["FACT_NULL_KEYS"]
    assert got["failed_count"] == 25 and len(json.loads(got["sample_rows"])["sample_rows"]) == 10


def test_negative_measures(spark):
    got = report(spark, [fact_row(D, quantity=-1), fact_row(D, "2", sales=0), fact_row(D, "3", sales=None)])
    assert got["FACT_NON_NEGATIVE"]["failed_count"] == 1


def test_duplicates_count_groups(spark):
    got = report(spark, [fact_row(D)] * 3 + [fact_row(D, "2")] * 2 + [fact_row(D, "3")])
    assert got["FACT_DUPLICATES"]["failed_count"] == 2


def test_checks_see_only_the_window(spark):
    got = report(spark, [fact_row(D - dt.timedelta(days=8), None), fact_row(D + dt.timedelta(days=3), None)])
    assert got["FACT_NULL_KEYS"]["failed_count"] == 1  # there is no upper bound


# ---- anomalies --------------------------------------------------------------------------------------


def stats_of(spark, rows, as_written):
    as_of = D + dt.timedelta(days=1)
    got = anomalies.trailing_item_stats(facts(spark, rows), as_of, 0, as_written)
    return {r["metric_name"]: r for r in got.filter(F.col("date") == as_of).collect()}


def test_literal_definition_repeats_history_per_scored_row(spark):
    history = [fact_row(D, location="x", sales=1), fact_row(D, location="y", sales=5)]
    one = [fact_row(D + dt.timedelta(days=1), sales=2)]
    for as_written in (False, True):
        got = stats_of(spark, history + one, as_written)["NET_SALES"]
        assert (got["mean"], got["median"], got["n"]) == (3, 3, 2)
        assert got["sd"] == pytest.approx(2.8284271)
    two = one + [fact_row(D + dt.timedelta(days=1), location="y", sales=2)]
    assert stats_of(spark, history + two, True)["NET_SALES"]["sd"] == pytest.approx(2.3094011)
    assert stats_of(spark, history + two, False)["NET_SALES"]["sd"] == pytest.approx(2.8284271)


def test_one_day_of_history_has_no_score_and_no_flag(spark):
    rows = [fact_row(D, sales=1), fact_row(D + dt.timedelta(days=1), sales=1000)]
    got = anomalies.detect_anomalies(facts(spark, rows), D + dt.timedelta(days=1), 0).collect()
    assert len(got) == 2
    assert all(r["zscore"] is None and r["robust_zscore"] is None and r["anomaly_flag"] is False for r in got)


def test_an_outlier_is_flagged_and_the_context_leaves_nulls_out(spark):
    rows = [fact_row(D - dt.timedelta(days=i), sales=10 + i % 3, quantity=5) for i in range(1, 30)]
    rows += [fact_row(D, sales=500, quantity=5, location=None)]
    got = {r["metric_name"]: r for r in anomalies.detect_anomalies(facts(spark, rows), D, 0).collect()}
    assert got["NET_SALES"]["anomaly_flag"] is True and got["QUANTITY"]["anomaly_flag"] is False
    assert json.loads(got["NET_SALES"]["context"]) == {"brand": "B", "country": "C"}


def test_history_ends_sixty_days_back_and_the_day_before(spark):
    rows = [fact_row(D - dt.timedelta(days=i), sales=i) for i in (0, 1, 60, 61)]
    got = anomalies.trailing_item_stats(facts(spark, rows), D, 0).filter("metric_name = 'NET_SALES'").collect()
    assert [(r["n"], r["mean"]) for r in got] == [(2, 30.5)]


# ---- the daily run ------------------------------------------------------------------------------------


def content(run, name):
    drop = {"last_updated_at", "detected_at", "run_ts"}
    df = run.mart(name)
    return sorted(map(str, df.drop(*[c for c in df.columns if c in drop]).collect()))


def test_daily_run_twice(spark, sf_dir):
    tables = RoleTables(spark, sf_dir)
    as_of = latest_order_date(tables)
    run = DailyRun(spark, tables, scratch_path(spark, "marts"), as_of)
    log = run.run(30).collect()
    assert [(r["step"], r["success"]) for r in log] == [
        ("build_fact", True), ("build_kpi", True), ("run_checks", True), ("detect", True)
    ]
    first = {name: content(run, name) for name in ("fact_daily_item_sales", "kpi_daily_brand", "sales_anomalies")}
    assert all(first.values())
    again = DailyRun(spark, tables, run.root, as_of)
    again.run(30)
    assert {name: content(again, name) for name in first} == first
    assert again.mart("dq_results").count() == 6 and read_mart(spark, run.root, "run_log").count() == 8
    assert again.mart("fact_daily_item_sales").filter("last_updated_at IS NULL").count() == 0


def test_a_failing_step_is_logged_and_ends_the_run(spark, sf_dir):
    tables = RoleTables(spark, sf_dir)
    run = DailyRun(spark, tables, scratch_path(spark, "marts"), latest_order_date(tables))

    def broken(days_back):
        raise ValueError("x" * 5000)

    run.build_kpi = broken
    with pytest.raises(ValueError):
        run.run()
    log = read_mart(spark, run.root, "run_log").collect()
    assert sorted((r["step"], r["success"], len(r["error"])) for r in log) == [
        ("build_fact", True, 0), ("build_kpi", False, 2000)
    ]


def test_late_rows_reach_a_second_run_of_the_same_object(spark, sf_dir):
    tables = RoleTables(spark, sf_dir)
    as_of = latest_order_date(tables)
    early = RoleTables(spark, sf_dir)
    early["order_detail"] = tables["order_detail"].filter("line_number = 1")
    run = DailyRun(spark, early, scratch_path(spark, "marts"), as_of)

    def lines():
        return run.mart("fact_daily_item_sales").agg(F.sum("order_lines")).first()[0]

    run.run(30)
    before = lines()
    early["order_detail"] = tables["order_detail"]
    run.run(30)
    assert lines() > before


def test_nothing_is_said_about_facts_that_were_never_built(spark, sf_dir, tmp_path):
    tables = RoleTables(spark, sf_dir)
    run = DailyRun(spark, tables, str(tmp_path / "none"), latest_order_date(tables))
    for step in (run.run_checks, run.build_kpi, run.detect):
        with pytest.raises(FileNotFoundError):
            step()
    spark.range(1).write.parquet(str(tmp_path / "none/fact_daily_item_sales"))
    with pytest.raises(ValueError, match="no column"):
        run.run_checks()


def test_distinct_orders_add_up_over_days_and_brands(spark):
    rows = [(D, "A", 1), (D, "A", 1), (D, "B", 1), (D - dt.timedelta(days=1), "A", 1), (D - dt.timedelta(days=1), "A", 32_769), (D, "A", 10**12), (D, "A", None), (D - dt.timedelta(days=9), "B", 7)]
    orders = spark.createDataFrame([(dt.datetime.combine(d, dt.time(12)), b, o) for d, b, o in rows], "order_ts timestamp_ntz, truck_brand_name string, order_id bigint")
    kept = marts.order_bitmaps(orders)
    assert kept.count() == 6  # day, brand and block; a null order is in none
    since = D - dt.timedelta(days=3)
    assert {r[0]: r[1] for r in marts.distinct_orders(kept, since).collect()} == {"A": 3, "B": 1}
    assert marts.distinct_orders(kept, since, ()).collect()[0][0] == 3
    assert marts.distinct_orders(kept, D - dt.timedelta(days=9), ()).collect()[0][0] == 4

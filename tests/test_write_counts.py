"""Checks counted by the job that writes the facts."""

import datetime as dt

from pyspark.sql import functions as F
from test_marts import D, fact_row, facts

from marketday.operators.snapshots import SnapshotTable
from marketday.plans import quality
from marketday.plans.daily_run import DailyRun
from marketday.session import scratch_path
from marketday.sources.standin import RoleTables, latest_order_date


def written(spark, rows, cutoff=D):
    table, counts = SnapshotTable(spark, scratch_path(spark, "watched"), facts(spark, []).schema), quality.write_counts()
    n = table.rebuild(counts.prepare(rows), cutoff, counts.watch)
    return table, n, counts.found()


def test_counts_of_the_write_are_those_of_the_table(spark):
    rows = facts(spark, [
        fact_row(D, "1"), fact_row(D, "1", brand="other"), fact_row(D, "1", brand="third"), fact_row(D, None), fact_row(D, None, quantity=-1),
        fact_row(D, "2", location=None, sales=-2), fact_row(D, "3", sales=None), fact_row(D, "4"), fact_row(D, "4"),
        fact_row(D - dt.timedelta(days=1), None), fact_row(None, None),
    ])
    table, n, found = written(spark, rows)
    # rows before the window, and those without a day, are not written and not counted
    assert n == 9 and found == {"no_key": 3, "negative": 2, "twice": 3}
    assert table.read().columns == rows.columns
    assert quality.fact_checks_from(found, table.read(), D, 0).collect() == quality.fact_checks(table.read(), D, 0).collect()


def test_a_clean_window_is_not_read_again(spark):
    table, n, found = written(spark, facts(spark, [fact_row(D, str(i)) for i in range(5)]))
    report = quality.fact_checks_from(found, table.read(), D, 0)
    assert "parquet" not in report._jdf.queryExecution().executedPlan().toString().lower()
    assert n == 5 and report.collect() == quality.fact_checks(table.read(), D, 0).collect()


def test_nothing_to_write(spark):
    table, n, found = written(spark, facts(spark, []))
    assert n == 0 and found == {"no_key": 0, "negative": 0, "twice": 0}
    assert quality.fact_checks_from(found, table.read(), D, 0).collect() == quality.fact_checks(table.read(), D, 0).collect()


def test_daily_run_logs_what_the_write_has_counted(spark, sf_dir):
    t = RoleTables(spark, sf_dir)
    t["order_detail"] = t["order_detail"].withColumn(
        "quantity", F.when(F.col("menu_item_id") % 5 == 0, -F.col("quantity")).otherwise(F.col("quantity"))
    )
    run = DailyRun(spark, t, scratch_path(spark, "marts"), latest_order_date(t))
    run.run(30)
    columns = ["check_name", "status", "failed_count", "sample_rows"]
    logged = sorted(run.mart("dq_results").select(columns).collect())
    again = quality.fact_checks(run.mart("fact_daily_item_sales"), run.as_of, 30)
    assert [(r[0], r[2]) for r in logged] == sorted((r["check_name"], r["failed_count"]) for r in again.collect())
    assert any(r["failed_count"] > 0 for r in logged)

"""The fact mart fed by drops: equal to a full build, each file once, and only touched days written."""

import datetime as dt

import pytest

from marketday.operators.snapshots import NO_DAY, Overtaken
from marketday.plans import marts
from marketday.plans.daily_run import DailyRun
from marketday.plans.views import orders_v
from marketday.sources.standin import RoleTables
from marketday.streaming.facts import FactFeed, of_days


def drop(df, folder):
    df.write.mode("append").options(header="false", escape='"', emptyValue="").csv(folder)


def facts(df):
    return sorted(map(tuple, df.drop("last_updated_at").collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return RoleTables(spark, sf_dir)


@pytest.fixture
def feed(spark, tables, tmp_path):
    """A feed over three days of orders; lines of orders with an id divisible by 5 are missing yet."""
    made = FactFeed(spark, tables, str(tmp_path / "inbox"), str(tmp_path / "marts"))
    days = [r[0] for r in tables["order_header"].selectExpr("to_date(order_ts) AS d").distinct().orderBy("d").limit(3).collect()]
    made.days, made.headers = days, of_days(tables["order_header"], set(days))
    made.lines = tables["order_detail"].join(made.headers.select("order_id"), "order_id", "left_semi").select(tables["order_detail"].columns)
    drop(made.headers, f"{made.inbox}/order_header")
    drop(made.lines.filter("order_id % 5 <> 0"), f"{made.inbox}/order_detail")
    assert made.run() > 0
    return made


def whole(feed):
    return facts(marts.daily_item_sales(orders_v(feed.tables())))


def test_late_lines_rebuild_their_days_only(feed, tables):
    before = feed.mart.days()
    assert facts(feed.mart.read()) == whole(feed) and set(before) <= {d.isoformat() for d in feed.days}
    late = feed.lines.filter("order_id % 5 = 0")
    ids = [r[0] for r in late.select("order_id").distinct().orderBy("order_id").collect()]
    drop(late.filter(f"order_id = {ids[0]}"), f"{feed.inbox}/order_detail")
    day = feed.headers.filter(f"order_id = {ids[0]}").selectExpr("to_date(order_ts)").first()[0].isoformat()
    feed.run()
    now = feed.mart.days()
    assert {d for d in now if now[d] != before.get(d)} == {day}
    assert facts(feed.mart.read()) == whole(feed)


def test_nothing_new_commits_nothing(feed):
    versions, note = feed.mart.versions(), feed.mart.note()
    assert feed.run() == 0 and feed.fold(note["runs"]) == 0  # no new file; the same run once more
    assert feed.mart.versions() == versions and note == {"runs": 1}


def test_a_run_that_ends_after_loading_is_made_good(feed):
    drop(feed.lines.filter("order_id % 5 = 0"), f"{feed.inbox}/order_detail")
    old = facts(feed.mart.read())
    feed.load("order_detail", 2)  # ends here
    assert facts(feed.mart.read()) == old != whole(feed)
    feed.run()
    assert facts(feed.mart.read()) == whole(feed) and feed.mart.note() == {"runs": 2}


def test_a_feed_that_was_overtaken_changes_nothing(feed):
    drop(feed.lines.filter("order_id % 5 = 0"), f"{feed.inbox}/order_detail")
    feed.load("order_detail", 2)
    stale = FactFeed(feed.spark, feed.dimensions, feed.inbox, feed.root)
    seen = stale.mart.note()
    feed.fold(2)
    new = feed.mart.versions()
    with pytest.raises(Overtaken):
        stale.mart.replace(feed.mart.read(), set(feed.days), {"runs": 2}, seen)
    assert feed.mart.versions() == new


def test_lines_wait_for_headers_and_orders_without_a_time_have_a_folder(spark, feed):
    row = feed.headers.limit(1)
    undated = row.selectExpr("* EXCEPT (order_id, order_ts)", "cast(-5 AS bigint) AS order_id", "cast(NULL AS timestamp_ntz) AS order_ts").select(row.columns)
    line = feed.lines.limit(1)
    own = line.selectExpr("* EXCEPT (order_id)", "cast(-5 AS bigint) AS order_id").select(line.columns)
    drop(own, f"{feed.inbox}/order_detail")
    old = facts(feed.mart.read())
    assert feed.run() == 0 and facts(feed.mart.read()) == old and feed.mart.note() == {"runs": 2}
    drop(undated, f"{feed.inbox}/order_header")
    assert feed.run() == 1 and NO_DAY in feed.mart.days()
    assert facts(feed.mart.read()) == whole(feed)


def test_the_daily_run_goes_on_from_the_feed(spark, feed):
    run = DailyRun(spark, feed.tables(), feed.root, max(feed.days))
    kept = feed.mart.note()
    run.run(7)
    assert feed.mart.note() == kept and facts(run.mart("fact_daily_item_sales")) == whole(feed)
    assert run.mart("kpi_daily_brand").count() > 0
    feed.mart.expire(1)
    assert feed.mart.note() == kept and isinstance(feed.days[0], dt.date)


def test_the_feed_keeps_no_shuffle_files(spark, feed):
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    assert all(".zstd.parquet" in f for f in feed.raw("order_detail").inputFiles())

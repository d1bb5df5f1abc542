"""Lines of other days are dropped before the shuffle, also where order ids do not grow with time."""

import pytest
from pyspark.sql import functions as F

from marketday.plans import marts
from marketday.session import RUNTIME_CONF
from marketday.sources.standin import RoleTables, latest_order_date

ON = "spark.sql.optimizer.runtime.bloomFilter.enabled"


@pytest.fixture
def as_big_tables(spark):
    """Plans as for lines of over 10 GB."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
        ON: spark.conf.get(ON),
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffled(df):
    """Rows that each exchange of the final plan has written, by the plan below it."""
    found = []

    def visit(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return visit(node.plan())
        if name == "ShuffleExchangeExec":
            found.append((node.toString(), node.metrics().apply("shuffleRecordsWritten").value()))
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(df._jdf.queryExecution().executedPlan())
    return found


def shuffled_ids(spark, sf_dir):
    t = RoleTables(spark, sf_dir)
    for name in ("order_header", "order_detail"):
        t[name] = t[name].withColumn("order_id", F.xxhash64("order_id"))
    return t


def lines_shuffled(spark, sf_dir):
    t = shuffled_ids(spark, sf_dir)
    fact = marts.build_fact(t, latest_order_date(t), 7).drop("location_id")
    rows = sorted(fact.collect())
    lines = max(n for _, n in shuffled(fact))  # the scan of the lines is the largest
    return rows, lines, fact._jdf.queryExecution().executedPlan().toString()


def test_fewer_lines_reach_the_shuffle(spark, sf_dir, as_big_tables):
    spark.conf.set(ON, "true")
    rows, few, plan = lines_shuffled(spark, sf_dir)
    spark.conf.set(ON, "false")
    same, many, without = lines_shuffled(spark, sf_dir)
    assert "might_contain" in plan and "might_contain" not in without
    assert rows == same and len(rows) > 0
    assert few < 0.1 * many


def test_settings_are_those_of_the_session(spark):
    assert all(spark.conf.get(k) == v for k, v in RUNTIME_CONF.items())

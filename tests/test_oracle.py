"""Every registered query against its oracle SQL, on the smallest test folder."""

import re

import oracle
import pytest

from marketday.registry import oracle_sql, queries

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("EvalPython|PythonUDF|MapInPandas|FlatMapGroups|CartesianProduct|NestedLoopJoin", plan)
    if name in SQL:
        assert oracle.compare(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(queries()) == set(SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, cwd=oracle.ROOT).returncode == 0

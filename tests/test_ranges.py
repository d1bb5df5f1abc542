"""Joins and sums over ranges of time, against brute force."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketday.operators.ranges import trailing_join, trailing_sums_at

SPAN = dt.timedelta(minutes=10)
START = dt.datetime(1969, 12, 31, 23, 0)  # bins on both sides of 1970


def rows(n=600, seed=3):
    """A third of the rows have one key; null keys, times and values; equal moments; times on the range's edge."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if i % 3 == 0 else rng.choice([None, 1, 2, 3])
        at = None if i % 50 == 7 else START + dt.timedelta(microseconds=rng.randrange(7200) * 1_000_000 + rng.choice([0, 0, 1]))
        out.append((i, key, at, None if i % 20 == 3 else Decimal(rng.randrange(-500, 5000)) / 100))
    out += [(n, 0, START, Decimal(1)), (n + 1, 0, START + SPAN, Decimal(2)), (n + 2, 0, START + SPAN + dt.timedelta(microseconds=1), Decimal(4))]
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "id bigint, k int, at timestamp_ntz, v decimal(10,2)")


@pytest.mark.parametrize("bins", [1, 7, 64])
def test_sums_are_those_of_all_pairs(spark, bins):
    data, spans = rows(), {"short": SPAN, "long": 5 * SPAN}
    got = trailing_sums_at(frame(spark, data), ["k"], "at", "v", spans, bins)
    assert got.columns == ["k", "at", "n_short", "total_short", "n_long", "total_long"]
    want = {}
    for _, k, at, _ in data:
        if at is not None:
            held = [[v for _, k2, t, v in data if k2 == k and t is not None and v is not None and at - s <= t < at] for s in spans.values()]
            want[k, at] = [x for h in held for x in (len(h), sum(h) if h else None)]
    assert {(r["k"], r["at"]): list(r[2:]) for r in got.collect()} == want


def test_sums_of_nothing_and_of_doubles(spark):
    nothing = frame(spark, [])
    assert trailing_sums_at(nothing, ["k"], "at", "v", {"s": SPAN}).count() == 0
    with pytest.raises(ValueError):
        trailing_sums_at(nothing.withColumn("v", F.col("v").cast("double")), ["k"], "at", "v", {"s": SPAN})
    with pytest.raises(ValueError):
        trailing_sums_at(nothing, ["k"], "at", "v", {"s": dt.timedelta(0)})


def test_pairs_are_those_of_all_pairs(spark):
    data = rows(300)
    left = frame(spark, data).select("k", F.col("id").alias("a"), F.col("at").alias("t"))
    right = frame(spark, data).select("k", F.col("id").alias("b"), F.col("at").alias("u"))
    got = trailing_join(left, right, ["k"], "t", "u", SPAN)
    assert got.columns == ["k", "a", "t", "b", "u"]
    want = sorted(
        (i, j) for i, k, t, _ in data for j, k2, u, _ in data
        if k is not None and k == k2 and t is not None and u is not None and t - SPAN <= u < t
    )
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want
    with pytest.raises(ValueError):
        trailing_join(left, left, ["k"], "t", "t", SPAN)


def test_no_nested_loop_and_a_window_of_one_bin(spark, sf_dir):
    from marketday.registry import queries

    for name in ("jn_range_events", "jn_trailing_events"):
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "sequence(" not in plan
        assert "bin" in plan

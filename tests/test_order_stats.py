import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from marketday.operators.order_stats import (
    band_bits, group_order_stats, ordered_bits, trailing_order_stats, units,
)
from marketday.operators.trailing import (
    daily_moments, sample_sd, trailing_moments, trailing_sums_by_frame, trailing_sums_by_join,
)

def brute(values):
    m = statistics.median(values)
    dev = [abs(v - m) for v in values]
    return len(values), m, sum(dev) / len(dev), statistics.median(dev)


def as_dict(df, keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def same(row, expected):
    got = (row["n"], row["median"], row["mean_abs_dev"], row["median_abs_dev"])
    assert got[0] == expected[0]
    assert got[1:] == pytest.approx(expected[1:], abs=1e-9, rel=1e-12)


def test_known_values(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 4.0, 8.0)] + [("b", 1.0), ("c", None)], "k string, x double")
    got = as_dict(group_order_stats(df, ["k"], "x"), "k")
    assert set(got) == {("a",), ("b",)}
    same(got["a",], (4, 3.0, 2.25, 1.5))
    same(got["b",], (1, 1.0, 0.0, 0.0))


@pytest.mark.parametrize("seed", range(7))
def test_against_brute_force(spark, seed):
    """Groups of very different sizes (one holds most rows), ties, negative and far-out values."""
    rng = random.Random(seed)
    draw = [
        lambda: rng.randint(-5, 5) / 100, lambda: rng.randint(0, 10**9) / 100, lambda: rng.choice([0.0, 1.0]),
        lambda: round(rng.lognormvariate(3, 4), 2), lambda: rng.choice([0.001, 0.002, 0.004, -0.0, 1e-300]),
        lambda: rng.uniform(-1, 1) * 10.0 ** rng.randint(-200, 200), lambda: 1e15 + rng.random(),
    ][seed]
    rows = [(0 if rng.random() < 0.7 else rng.randint(1, 30), draw()) for _ in range(1500)]
    groups = {}
    for k, x in rows:
        groups.setdefault(k, []).append(x)
    got = as_dict(group_order_stats(spark.createDataFrame(rows, "k int, x double"), ["k"], "x"), "k")
    assert len(got) == len(groups)
    for k, values in groups.items():
        same(got[k,], brute(values))


def test_small_digits_are_not_lost(spark):
    df = spark.createDataFrame([(None, x) for x in (0.001, 0.002, 0.004)], "k string, x double")
    row = group_order_stats(df, ["k"], "x").first()
    assert (row["k"], row["n"], row["median"]) == (None, 3, 0.002)
    assert row["median_abs_dev"] == 0.001
    with pytest.raises(Exception, match="digits after the point"):
        df.select(units(F.col("x"), 2)).collect()


def test_bits_order_like_values(spark):
    rng = random.Random(2)
    values = [s * m * 2.0**e for s in (-1, 1) for e in range(-999, 1023, 37) for m in (1.0, 1.9999999999999998, 1 + rng.random())]
    values += [0.0, 1.7976931348623157e308, -1.7976931348623157e308]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", ordered_bits(F.col("x")).alias("v"))
    rows = sorted((r["x"], r["v"]) for r in df.collect())
    assert [v for _, v in rows] == sorted({v for _, v in rows})
    with pytest.raises(Exception, match="no order statistics"):
        spark.createDataFrame([(float("inf"),)], "x double").select(ordered_bits(F.col("x"))).collect()


@pytest.mark.parametrize("years", [1, 4])
def test_frames_meet_a_bounded_number_of_values(spark, years):
    """The join by blocks of days reads a bounded multiple of what it keeps, however long the history."""
    start, days = dt.date(2020, 1, 1), 365 * years
    df = spark.range(days * 3).select(
        F.lit(1).alias("k"), F.date_add(F.lit(start), (F.col("id") % days).cast("int")).alias("day"), (F.col("id") * 7919 % 500).alias("v")
    )
    stats = trailing_order_stats(df, ["k"], "day", start, start + dt.timedelta(days=days - 1), F.lit(4), F.lit(1.0), window=60, median_dev=False)
    assert stats.count() == days - 1
    daily = df.groupBy("k", "day", "v").count().withColumn("block", F.floor(F.unix_date("day") / 60))
    frames = df.select("k", F.col("day").alias("d")).distinct().withColumn(
        "block", F.explode(F.sequence(F.floor(F.unix_date(F.date_sub("d", 60)) / 60), F.floor(F.unix_date(F.date_sub("d", 1)) / 60)))
    )
    met = frames.join(daily, ["k", "block"])
    kept = met.filter(F.col("day").between(F.date_sub("d", 60), F.date_sub("d", 1))).count()
    assert met.count() < 5 * kept


def fact(seed=1, days=40):
    rng = random.Random(seed)
    start = dt.date(2024, 1, 1)
    rows = []
    for _ in range(900):
        item = 0 if rng.random() < 0.5 else rng.randint(1, 6)
        rows.append((item, start + dt.timedelta(days=rng.randint(0, days - 1)), rng.randint(0, 5000)))
    return rows, start, start + dt.timedelta(days=days - 1)


def test_trailing_against_brute_force(spark):
    rows, start, last = fact()
    first = start + dt.timedelta(days=25)
    df = spark.createDataFrame(rows, "k int, day date, v bigint")
    got = as_dict(
        trailing_order_stats(
            df, ["k"], "day", first, last, F.lit(band_bits(5000)), F.lit(1.0), window=10
        ),
        ["k", "day"],
    )
    expected = {}
    for k in range(7):
        day = first
        while day <= last:
            frame = [v for kk, d, v in rows if kk == k and 1 <= (day - d).days <= 10]
            if frame:
                expected[k, day] = brute(frame)
            day += dt.timedelta(days=1)
    assert set(got) == set(expected)
    for key, want in expected.items():
        same(got[key], want)


@pytest.mark.parametrize("factor", [1, 64, 4096])
def test_bands_do_not_grow_with_the_values(spark, factor):
    """Few large values to a frame: as many bands for any factor, and the same statistics times the factor."""
    rng = random.Random(5)
    first, last = dt.date(2024, 1, 1), dt.date(2024, 2, 9)
    rows = [
        (first + dt.timedelta(days=d), factor * rng.choice([rng.randint(0, 1 << 24), -3, 1 << 34]))
        for d in range(40) for _ in range(25)
    ]
    bits, plain = band_bits(factor << 34, factor << 24, 25 * 10), band_bits(factor << 34)
    assert bits == max(plain, (factor << 24).bit_length() - 4)
    assert len({v >> bits for _, v in rows if 0 <= v <= factor << 24}) <= 33
    df = spark.createDataFrame([("a", *r) for r in rows], "k string, day date, v long")
    got = as_dict(trailing_order_stats(df, ["k"], "day", first, last, F.lit(bits), F.lit(1.0), window=10), ["day"])
    for d in range(1, 40):
        day = first + dt.timedelta(days=d)
        same(got[day,], brute([v for at, v in rows if day - dt.timedelta(days=10) <= at < day]))


def test_wide_bands_only_where_frames_are_small():
    assert band_bits(1 << 34, 1 << 30, (1 << 20) + 1) == band_bits(1 << 34) == 20 < band_bits(1 << 34, 1 << 30, 1 << 20)
    assert band_bits(None, None, 0) == band_bits(0) == 1


def test_trailing_moments_pool_all_rows(spark):
    rows, _, _ = fact(3)
    df = spark.createDataFrame([(k, d, float(v) + 1e9) for k, d, v in rows], "k int, day date, x double")
    got = trailing_moments(daily_moments(df, ["k"], "day", "x"), ["k"], "day", 10)
    got = as_dict(got.withColumn("sd", sample_sd(F.col("m2"), F.col("n"))), ["k", "day"])
    assert len(got) == len({(k, d) for k, d, _ in rows})
    for (k, day), row in got.items():
        frame = [v + 1e9 for kk, d, v in rows if kk == k and 1 <= (day - d).days <= 10]
        assert row["n"] == len(frame)
        if frame:
            assert row["mean"] == pytest.approx(statistics.fmean(frame))
        if len(frame) > 1:
            assert row["sd"] == pytest.approx(statistics.stdev(frame), rel=1e-6)
        else:
            assert row["sd"] is None


def test_frame_join_and_theta_join_agree(spark):
    rows, _, _ = fact(5)
    df = spark.createDataFrame(rows, "k int, day date, v bigint").groupBy("k", "day").agg(F.sum("v").alias("v"))
    a, b = df.alias("a"), df.alias("b")
    theta = (
        a.join(
            b,
            (F.col("a.k") == F.col("b.k"))
            & F.col("b.day").between(F.date_sub("a.day", 10), F.date_sub("a.day", 1)),
            "left",
        )
        .groupBy("a.k", "a.day").agg(F.count("b.v").alias("days"), F.sum("b.v").alias("total"))
    )
    want = sorted(map(tuple, theta.collect()))
    assert sorted(map(tuple, trailing_sums_by_frame(df, ["k"], "day", "v", 10).collect())) == want
    assert sorted(map(tuple, trailing_sums_by_join(df, ["k"], "day", "v", 10).collect())) == want


def test_only_the_frames_asked_for(spark):
    """A key with few rows costs its own frames, not every day of the calendar; the results of those are the same."""
    rows, start, last = fact()
    df = spark.createDataFrame(rows, "k int, day date, v bigint")
    first = start + dt.timedelta(days=15)
    asked = df.filter((F.col("day") >= F.lit(first)) & (F.col("k") + F.dayofmonth("day") < 12)).select("k", "day")
    args = (df, ["k"], "day", first, last, F.lit(band_bits(5000)), F.lit(1.0))
    everything = as_dict(trailing_order_stats(*args, window=10), ["k", "day"])
    got = as_dict(trailing_order_stats(*args, window=10, wanted=asked), ["k", "day"])
    keys = {(r["k"], r["day"]) for r in asked.collect()}
    assert got and set(got) == keys & set(everything)
    for key, row in got.items():
        assert row == everything[key]


def test_no_frames_through_the_driver(spark):
    """One row per frame is a few MB when stored, whatever it takes in memory: none is broadcast."""
    rows, start, last = fact()
    df = spark.createDataFrame(rows, "k int, day date, v bigint")
    stats = trailing_order_stats(df, ["k"], "day", start, last, F.lit(4), F.lit(1.0), window=10, wanted=df)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Scan parquet" in plan
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "block" not in line]

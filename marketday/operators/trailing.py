"""Trailing-day statistics per key, the current day excluded.

Both forms first reduce the rows to one record per (key, day).  What reaches a window is then
bounded by the calendar, not by the data: a key holding a third of all rows still has one record a
day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_moments(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Count, mean and sum of squared distances from the mean, per key and day (``rows`` counts NULLs too)."""
    x = F.col(value).cast("double")
    return df.groupBy(*keys, day).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        (F.var_pop(x) * F.count(x)).alias("m2"),
    )


def _pooled(column: str) -> list:
    """Count, mean and squared distances of several days' records taken together."""
    days = F.col(column)
    n = F.aggregate(days, F.lit(0).cast("bigint"), lambda a, d: a + d["n"])
    total = F.aggregate(days, F.lit(0.0), lambda a, d: a + d["n"] * d["mean"])
    return [n.alias("n"), F.try_divide(total, n).alias("mean")]


def trailing_moments(daily: DataFrame, keys: list[str], day: str, window: int = 60) -> DataFrame:
    """Pooled ``n``, ``mean`` and ``m2`` over ``[d - window, d - 1]`` for every (key, day) present.

    The frame holds at most ``window`` daily records; pooling them by their distances from the
    pooled mean avoids the cancellation of the sum-of-squares formula.
    """
    frame = (
        Window.partitionBy(*keys)
        .orderBy(F.unix_date(F.col(day)))
        .rangeBetween(-window, -1)
    )
    record = F.when(F.col("n") > 0, F.struct("n", "mean", "m2"))
    return (
        daily.select(*keys, day, "rows", F.collect_list(record).over(frame).alias("days"))
        .select(*keys, day, "rows", "days", *_pooled("days"))
        .withColumn(
            "m2",
            F.aggregate(
                F.transform("days", lambda d: d["m2"] + d["n"] * F.pow(d["mean"] - F.col("mean"), 2)),
                F.lit(0.0), lambda a, x: a + x,
            ),
        )
        .drop("days")
    )


def sample_sd(m2, n):
    """Sample standard deviation; NULL below two values."""
    return F.sqrt(F.try_divide(m2, F.nullif(F.greatest(n - 1, F.lit(0)), F.lit(0))))


def trailing_sums_by_frame(daily: DataFrame, keys: list[str], day: str, value: str, window: int = 60) -> DataFrame:
    """Trailing sum of a daily value as a range frame."""
    frame = Window.partitionBy(*keys).orderBy(F.unix_date(F.col(day))).rangeBetween(-window, -1)
    return daily.select(
        *keys, day, F.count(value).over(frame).alias("days"), F.sum(value).over(frame).alias("total")
    )


def trailing_sums_by_join(daily: DataFrame, keys: list[str], day: str, value: str, window: int = 60) -> DataFrame:
    """The same as an equi join: each record is repeated for the days whose frame covers it.

    Needs no sort and no partition per key; one more group-by puts the frames together.
    """
    covered = (
        daily.withColumn(day, F.explode(F.sequence(F.date_add(day, 1), F.date_add(day, window))))
        .groupBy(*keys, day)
        .agg(F.count(value).alias("days"), F.sum(value).alias("total"))
    )
    return daily.select(*keys, day).join(covered, [*keys, day], "left").select(
        *keys, day, F.coalesce("days", F.lit(0)).alias("days"), "total"
    )

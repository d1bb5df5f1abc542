"""Idempotent rebuild of the trailing days of a mart table.

The rule: rows dated at or after the cutoff are replaced by the recomputed ones; a day that has no
recomputed row ends up empty; older rows and rows without a date stay.  Data arriving up to
``days_back`` days late is picked up because the whole window is recomputed; older arrivals are not.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketday.session import exists, stage


def cutoff_date(as_of: dt.date, days_back: int) -> dt.date:
    return as_of - dt.timedelta(days=days_back)


def in_window(day, cutoff: dt.date):
    """True for days from the cutoff on.  There is no upper bound: later-dated rows are included."""
    return day >= F.lit(cutoff)


def rebuilt(target: DataFrame, fresh: DataFrame, cutoff: dt.date, day: str = "date") -> DataFrame:
    """The table after the rebuild, as a DataFrame."""
    kept = target.filter(F.col(day).isNull() | ~in_window(F.col(day), cutoff))
    return kept.unionByName(fresh)


def rebuild_partitions(fresh: DataFrame, path: str, cutoff: dt.date, day: str = "date") -> int:
    """Rebuild the window of a Parquet table partitioned by ``day``, in place; rows written.

    Only partitions from the cutoff on are written: history is neither read nor copied.  The fresh
    rows are staged first, so the table is touched only once they are complete.  Days of the window without
    fresh rows are emptied first; then one dynamic overwrite replaces every day that has some.  A reader may find a day
    missing while it is replaced, but never twice and, once the overwrite has begun, no day that should be
    gone.  A run that dies half-way is repaired by running it again.
    """
    spark = fresh.sparkSession
    fresh = stage(fresh.filter(in_window(F.col(day), cutoff)), "window")
    days = {r[day]: r["n"] for r in fresh.groupBy(day).agg(F.count(F.lit(1)).alias("n")).collect()}
    old_days = _window_days(spark, path, cutoff, day)
    nothing = fresh.drop(day).limit(0)
    for stale in sorted(old_days - set(days)):  # at most the days of the window
        nothing.write.mode("overwrite").parquet(f"{path}/{day}={stale.isoformat()}")
    (
        # One shuffle by day; the hint lets AQE split a big day and merge small ones.
        fresh.hint("rebalance", F.col(day))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(day).parquet(path)
    )
    return sum(days.values())


def _window_days(spark: SparkSession, path: str, cutoff: dt.date, day: str) -> set[dt.date]:
    if not exists(spark, path):
        return set()
    existing = spark.read.parquet(path)
    return {r[0] for r in existing.filter(in_window(F.col(day), cutoff)).select(day).distinct().collect()}

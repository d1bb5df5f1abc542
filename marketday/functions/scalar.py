"""Guarded arithmetic used by the marts, as Column helpers and as SQL functions.

All of it stays inside Catalyst expressions.  Results are fractional; writers round to the scale of
their target column.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: scales a median absolute deviation to a normal standard deviation.
MAD_SCALE = 1.4826


def _over(numerator: Column, divisor: Column) -> Column:
    return F.try_divide(numerator.cast("double"), F.nullif(divisor.cast("double"), F.lit(0.0)))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """NULL where the denominator is NULL or zero; decimals are divided as decimals."""
    return F.try_divide(numerator, F.nullif(denominator, F.lit(0)))


def zscore(x: Column, mean: Column, stddev: Column) -> Column:
    """Distance from the mean in standard deviations; NULL where those are NULL or zero."""
    return _over(x.cast("double") - mean.cast("double"), stddev)


def robust_zscore(x: Column, median: Column, mad: Column) -> Column:
    """Distance from the median in scaled deviations; NULL where those are NULL or zero."""
    return _over(x.cast("double") - median.cast("double"), F.lit(MAD_SCALE) * mad.cast("double"))


def coalesce_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


SQL_FUNCTIONS = {
    "safe_divide": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN try_divide(a, nullif(b, 0D))",
    "zscore": "(x DOUBLE, m DOUBLE, s DOUBLE) RETURNS DOUBLE RETURN try_divide(x - m, nullif(s, 0D))",
    "robust_zscore": "(x DOUBLE, m DOUBLE, d DOUBLE) RETURNS DOUBLE "
    f"RETURN try_divide(x - m, nullif({MAD_SCALE}D * d, 0D))",
    "coalesce_zero": "(x DOUBLE) RETURNS DOUBLE RETURN coalesce(x, 0D)",
}


def register(spark: SparkSession) -> None:
    """Create the four functions as temporary SQL functions; Spark inlines their bodies."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {body}")

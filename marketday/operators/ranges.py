"""Joins and sums over ranges of time, without a grid of days and without comparing all rows of a key.

Times are compared as whole microseconds.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(time: str) -> Column:
    """A timestamp, with a zone or without, as microseconds since 1970."""
    return F.unix_micros(F.col(time).cast("timestamp"))


def _length(span: dt.timedelta) -> int:
    length = span // dt.timedelta(microseconds=1)
    if length <= 0:
        raise ValueError("the range must be longer than nothing")
    return length


def _bin(at: str, width: int) -> Column:
    """The number of the bin of ``width`` microseconds, counted from 1970 and negative before."""
    return F.expr(f"({at} - pmod({at}, {width}L)) div {width}L")


def trailing_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, span: dt.timedelta
) -> DataFrame:
    """Pairs with equal keys whose right row lies in ``[t - span, t)``, ``t`` being the left row's time.

    An equi join on keys and bin, bins as long as the range: a right row stands in its own bin, a left row asks in its
    own and the one before, so each pair meets in exactly one bin, and the exact range is a filter of the join.  A
    hot key is dealt over its bins, and AQE splits a bin that is still hot.  Only the result can grow faster than the
    rows; sums over such ranges are cheaper by :func:`trailing_sums_at`.  Rows with a null key or time are in no pair.
    The columns of the two sides, keys aside, must have different names; ``_at``, ``_asked`` and ``_bin`` must be free.
    """
    length = _length(span)
    if twice := (set(left.columns) & set(right.columns)) - set(keys):
        raise ValueError(f"columns of both sides: {', '.join(sorted(twice))}")
    own = _bin("_asked", length)
    asking = left.withColumn("_asked", micros(left_time)).withColumn("_bin", F.explode(F.array(own, own - 1)))
    standing = right.withColumn("_at", micros(right_time)).withColumn("_bin", _bin("_at", length))
    gap = F.col("_asked") - F.col("_at")
    return asking.join(standing, [*keys, "_bin"]).filter((gap > 0) & (gap <= length)).drop("_asked", "_at", "_bin")


def trailing_sums_at(
    df: DataFrame, keys: list[str], time: str, value: str, spans: dict[str, dt.timedelta], bins: int = 64
) -> DataFrame:
    """For every key and moment present, and every named span: ``n_<name>`` and ``total_<name>`` of the key's values in ``[t - span, t)``.

    The work grows with the rows, not with the pairs.  What lies before a moment is the sum of the earlier bins (``bins``
    of them in the longest span) plus that of the earlier moments in its bin; each moment asks at ``t`` and at every
    ``t - span``, and the answers are subtracted.  Rows of one key and moment are added up first; moments and
    questions then meet in windows of one key and *bin*, so a key with a third of all rows is dealt over its bins, and
    the sums of whole bins run over one record a bin.  ``value`` must be a whole number or a decimal, which subtract
    without error.  Rows without a time are in no moment; null keys are a key like any other; a total of no values is null.
    Names that begin with ``_`` are used inside.
    """
    lengths = {name: _length(span) for name, span in spans.items()}
    if df.schema[value].dataType.typeName() in ("double", "float"):
        raise ValueError(f"{value} is a floating point number, whose sums cannot be subtracted without error")
    moments = df.filter(F.col(time).isNotNull()).groupBy(*keys, time).agg(
        F.count(value).alias("_n"), F.coalesce(F.sum(value), F.lit(0)).alias("_total")
    )
    sums = ("_n", "_total")

    def ask(name: str) -> Column:
        """The moment itself, which brings its values along, or a question one span earlier, which brings none."""
        at = micros(time) - F.lit(lengths.get(name, 0)).cast("bigint")
        held = [F.lit(0).cast(moments.schema[c].dataType) if name else F.col(c) for c in sums]
        return F.struct(F.lit(name).alias("_span"), at.alias("_asked"), *[h.alias(c) for h, c in zip(held, sums)])

    asked = F.inline(F.array(*[ask(name) for name in ["", *lengths]]))
    points = moments.select(*keys, F.col(time).alias("_time"), asked).withColumn(
        "_bin", _bin("_asked", max(1, max(lengths.values()) // bins))
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_asked").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = points.groupBy(*keys, "_bin").agg(*[F.sum(c).alias(c) for c in sums]).select(
        *[F.col(c).alias(f"_of_{c}") for c in [*keys, "_bin"]], *[F.sum(c).over(before).alias(f"_bins{c}") for c in sums]
    )
    answers = points.select(
        *keys, "_time", "_span", "_bin", *[F.sum(c).over(inside).alias(f"_inside{c}") for c in sums]
    ).join(whole, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*keys, "_bin"]])

    def answer(name: str, c: str) -> Column:
        both = F.coalesce(f"_bins{c}", F.lit(0)) + F.coalesce(f"_inside{c}", F.lit(0))
        return F.max(F.when(F.col("_span") == name, both))

    per_moment = answers.groupBy(*keys, "_time").agg(
        *[(answer("", c) - answer(name, c)).alias(f"{c[1:]}_{name}") for name in lengths for c in sums]
    )
    return per_moment.select(*keys, F.col("_time").alias(time), *[
        column for name in lengths
        for column in (F.col(f"n_{name}"), F.when(F.col(f"n_{name}") > 0, F.col(f"total_{name}")).alias(f"total_{name}"))
    ])

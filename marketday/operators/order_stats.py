"""Exact medians and deviations that do not collect a group in one place.

Spark's exact percentile keeps a group's values in one task, and a window over a group sorts it in
one task; with one group holding a third of all rows both stop scaling.

Groups: values are counted per distinct value, which combines on the map side, and the middle ranks are
found digit by digit.  A double's 64 bits, read as a whole number that orders like the value, are split into
four digits; counting the first digit tells which one holds a middle rank, and only values with that
digit are counted by the next.  Every window sees the digits of one group, never its values, and the work
is one aggregation a digit whatever the distribution.  Deviations are values like any others.

Trailing frames of days: whole units (cents, pieces) are counted per day and added up into bands of
neighbouring values.  A frame's bands are the days' bands added up, running totals tell which
one or two hold the middle ranks, and only their values are looked at again, joined on
(key, band, block of days): a frame meets the one or two blocks it touches, however long the history.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketday.session import stage

LOWER, UPPER = "(n + 1) div 2", "n div 2 + 1"  # ranks of the two middle values, equal for odd n
DIGITS = (48, 32, 16, 0)  # bits below each digit
SMALLEST = -1000  # binary exponent; nearer to zero than that is refused


def ordered_bits(x: Column) -> Column:
    """A double as a whole number that orders like it: sign, exponent, fraction.

    The logarithm only suggests the exponent; multiplying by powers of two is exact and corrects it.
    """
    size = F.abs(x)
    guess = F.greatest(F.floor(F.log2(size)).cast("int"), F.lit(SMALLEST))
    first = size * F.pow(F.lit(2.0), -guess)
    exponent = guess + F.when(first < 1, -1).when(first >= 2, 1).otherwise(0)
    whole = (size * F.pow(F.lit(2.0), -exponent) * float(2**52)).cast("bigint")
    bits = (exponent - SMALLEST + 2).cast("bigint") * 2**52 + whole - 2**52
    refused = F.raise_error(F.concat(F.lit("no order statistics of "), x.cast("string"))).cast("bigint")
    bits = F.when(size == 0, F.lit(0).cast("bigint")).when(size.between(2.0**SMALLEST, 1.7976931348623157e308), bits).otherwise(refused)
    return F.when(x < 0, -bits).otherwise(bits)


def units(col: Column, scale: int) -> Column:
    """A value as a whole number of its smallest units; a value with more digits is an error."""
    whole = col.cast(f"decimal(28,{scale})")
    lost = F.raise_error(F.concat(F.lit(f"more than {scale} digits after the point: "), col.cast("string")))
    return F.when(col.isNull() | (whole == col), (whole * 10**scale).cast("bigint")).otherwise(lost.cast("bigint"))


def _matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys in which NULL meets NULL."""
    right = right.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in right.columns])
    same = reduce(Column.__and__, [left[k].eqNullSafe(right[f"_{k}"]) for k in keys], F.lit(True))
    return left.join(right, same).drop(*[f"_{k}" for k in keys])


def _middle(counted: DataFrame, groups: list[str]) -> DataFrame:
    """Per group ``n`` and ``median``: ``counted`` has groups, the value ``x``, its order ``v`` and its count ``c``."""
    digits = [F.call_function("shiftright", F.col("v"), F.lit(s)) for s in DIGITS]
    group = Window.partitionBy(*groups)
    sums = counted.groupBy(*groups, digits[0].alias("p")).agg(F.sum("c").alias("c"))
    ranks = F.array(F.struct(F.lit(0).alias("w"), F.expr(LOWER).alias("r")), F.struct(F.lit(1).alias("w"), F.expr(UPPER).alias("r")))

    def holding(sums: DataFrame, frame) -> DataFrame:
        """The digit that holds each wanted rank, and the rank among the values with that digit."""
        upto = sums.withColumn("upto", F.sum("c").over(frame.orderBy("p")))
        return upto.filter("upto >= r AND upto - c < r").select(*groups, "w", (F.col("r") - F.col("upto") + F.col("c")).alias("r"), "n", "p")

    wanted = sums.withColumn("n", F.sum("c").over(group)).withColumn("t", F.explode(ranks)).select(*groups, "t.w", "t.r", "n", "p", "c")
    wanted = holding(wanted, Window.partitionBy(*groups, "w"))
    for above, digit in zip(digits, digits[1:]):
        inside = _matched(counted.withColumn("p", above), wanted, [*groups, "p"])
        sums = inside.groupBy(*groups, "w", "r", "n", digit.alias("p")).agg(F.sum("c").alias("c"), F.min("x").alias("x"))
        upto = sums.withColumn("upto", F.sum("c").over(Window.partitionBy(*groups, "w").orderBy("p")))
        wanted = upto.filter("upto >= r AND upto - c < r").select(*groups, "w", (F.col("r") - F.col("upto") + F.col("c")).alias("r"), "n", "p", "x")
        last, wanted = wanted, wanted.drop("x")
    return last.groupBy(*groups).agg(F.first("n").alias("n"), ((F.min("x") + F.max("x")) / 2).alias("median"))


def group_order_stats(df: DataFrame, keys: list[str], value: str, median_dev: bool = True) -> DataFrame:
    """``n``, ``median``, ``mean_abs_dev`` and ``median_abs_dev`` of a column of doubles per group.

    Missing values (NULL and NaN) are left out; infinite ones are an error.  The medians are values of the column, or the
    mean of two; deviations are differences of doubles.
    """
    x = F.col(value).cast("double")
    known = df.filter(x.isNotNull() & ~F.isnan(x)).select(*keys, (x + 0.0).alias("x"))
    counted = known.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c")).withColumn("v", ordered_bits(F.col("x")))
    counted = stage(counted, "counts")
    medians = stage(_middle(counted, keys), "medians")
    away = _matched(counted.select(*keys, "x", "c"), medians, keys).withColumn("d", F.abs(F.col("x") - F.col("median")))
    means = away.groupBy(*keys).agg((F.sum(F.col("d") * F.col("c")) / F.sum("c")).alias("mean_abs_dev"))
    out, columns = _matched(medians, means, keys), ["n", "median", "mean_abs_dev"]
    if median_dev:
        counted = away.groupBy(*keys, F.col("d").alias("x")).agg(F.sum("c").alias("c")).withColumn("v", ordered_bits(F.col("x")))
        spread = _middle(stage(counted, "deviations"), keys).select(*keys, F.col("median").alias("median_abs_dev"))
        out, columns = _matched(out, spread, keys), [*columns, "median_abs_dev"]
    return out.select(*keys, *columns)


# ---- trailing frames -------------------------------------------------------------------------------


def band_bits(largest, spread=None, most=None) -> int:
    """Width of a band, in bits, for values up to ``largest`` units.

    A band spans at most a million different values, however they are distributed; there are at
    least 32 bands (for ranges that have so many values) and, below 2**40 units, at most a million.
    Wider ranges are halved in bits: as many bands as values per band.

    Where no frame has over a million values (``most``, at most so many in one), no band holds more either, however wide.
    Bands then widen with the ``spread`` of the values: about the square root of a frame's values to it.  So a frame's
    bands do not grow with the values, and are about as many as the values that are looked at again.
    """
    bits = int(largest or 0).bit_length()
    bits = max(1, min(20, bits - 5), (bits + 1) // 2 if bits > 40 else 0)
    if spread and most and most <= 1 << 20:
        bits = max(bits, int(spread).bit_length() - int(most).bit_length() // 2)
    return bits


def _exact(col: str) -> Column:
    return F.col(col).cast("decimal(19,0)")


def _bands(counted: DataFrame, groups: list[str]) -> DataFrame:
    return counted.groupBy(*groups, "band").agg(
        F.sum("c").alias("c"), F.sum(_exact("v") * _exact("c")).alias("s")
    )


def _with_band(counted: DataFrame, bits: Column) -> DataFrame:
    return counted.withColumn("bits", bits.cast("int")).withColumn(
        "band", F.call_function("shiftright", "v", "bits")
    )


Fetch = Callable[[DataFrame], DataFrame]


def _medians(bands: DataFrame, groups: list[str], fetch: Fetch) -> DataFrame:
    """Per group: ``n``, ``m2`` (twice the median, in units) and ``mean_dev`` about the median."""
    group = Window.partitionBy(*groups)
    running = group.orderBy("band")
    middle = (
        bands
        .withColumn("n", F.sum("c").over(group)).withColumn("total", F.sum("s").over(group))
        .withColumn("upto", F.sum("c").over(running)).withColumn("upto_s", F.sum("s").over(running))
        .filter(f"upto >= {LOWER} AND upto - c < {UPPER}")
        .select(
            *groups, "band", "n", "total",
            F.struct((F.col("upto") - F.col("c")).alias("c"), (F.col("upto_s") - F.col("s")).alias("s")).alias("below"),
        )
    )
    running = group.orderBy("v")
    ranked = (
        fetch(middle)
        .withColumn("below", F.min("below").over(group))
        .withColumn("upto", F.col("below.c") + F.sum("c").over(running))
        .withColumn("upto_s", F.col("below.s") + F.sum(_exact("v") * _exact("c")).over(running))
    )
    picked = ranked.groupBy(*groups).agg(
        F.first("n").alias("n"), F.first("total").alias("total"),
        F.min(F.expr(f"CASE WHEN upto >= {LOWER} THEN struct(v, upto, upto_s) END")).alias("low"),
        F.min(F.expr(f"CASE WHEN upto >= {UPPER} THEN v END")).alias("high"),
    )
    m2 = F.col("low.v") + F.col("high")
    m2_exact, n_low, s_low = m2.cast("decimal(19,0)"), F.col("low.upto").cast("decimal(19,0)"), F.col("low.upto_s")
    spread = m2_exact * (2 * n_low - _exact("n")) + 2 * (F.col("total") - 2 * s_low)
    return picked.select(
        *groups, "n", m2.alias("m2"),
        (spread.cast("double") / (2 * F.col("n"))).alias("mean_dev"),
    )


def _median_deviations(
    bands: DataFrame, medians: DataFrame, groups: list[str], fetch: Fetch, bits: Column
) -> DataFrame:
    """Per group: ``mad4``, four times the median absolute deviation, in units.

    A band's values lie between a nearest and a farthest distance from the median.  Running counts
    in order of either distance bracket the middle ranks; bands wholly nearer are just counted,
    bands wholly farther are ignored, and only the bands in between are looked at by value.
    """
    group = Window.partitionBy(*groups)
    edges = (
        bands.join(medians.select(*groups, "n", "m2"), groups)
        .withColumn("bits", bits.cast("int"))
        .withColumn("from2", F.expr("2 * shiftleft(band, bits)"))
        .withColumn("to2", F.expr("from2 + 2 * (shiftleft(1L, bits) - 1)"))
        .withColumn("near", F.expr("greatest(from2 - m2, m2 - to2, 0L)"))
        .withColumn("far", F.expr("greatest(abs(from2 - m2), abs(to2 - m2))"))
        .withColumn("within_near", F.sum("c").over(group.orderBy("near")))
        .withColumn("within_far", F.sum("c").over(group.orderBy("far")))
        .withColumn("least", F.min(F.expr(f"CASE WHEN within_near >= {LOWER} THEN near END")).over(group))
        .withColumn("most", F.min(F.expr(f"CASE WHEN within_far >= {UPPER} THEN far END")).over(group))
        .withColumn("nearer", F.sum(F.expr("CASE WHEN far < least THEN c ELSE 0L END")).over(group))
        .filter("far >= least AND near <= most")
        .select(*groups, "band", "n", "m2", "nearer")
    )
    ranked = (
        fetch(edges)
        .withColumn("dev2", F.abs(2 * F.col("v") - F.col("m2")))
        .withColumn("upto", F.col("nearer") + F.sum("c").over(group.orderBy("dev2")))
    )
    return ranked.groupBy(*groups).agg(
        (
            F.min(F.expr(f"CASE WHEN upto >= {LOWER} THEN dev2 END"))
            + F.min(F.expr(f"CASE WHEN upto >= {UPPER} THEN dev2 END"))
        ).alias("mad4")
    )


def _by_bands(bands: DataFrame, groups: list[str], fetch: Fetch, bits: Column, median_dev: bool) -> DataFrame:
    # One row per group, used twice.  Stored, millions of them take a few MB, by which Spark would send them whole through the driver.
    medians = stage(_medians(bands, groups, fetch), "medians").hint("merge")
    cols = ["n", (F.col("m2") / 2).alias("median"), F.col("mean_dev").alias("mean_abs_dev")]
    out = medians
    if median_dev:
        out = out.join(_median_deviations(bands, medians, groups, fetch, bits), groups)
        cols.append((F.col("mad4") / 4).alias("median_abs_dev"))
    return out.select(*groups, *cols)


def _in_values(stats: DataFrame, groups: list[str], unit: Column) -> DataFrame:
    return stats.select(
        *groups, "n",
        *[(F.col(c) / unit).alias(c) for c in stats.columns if c not in [*groups, "n"]],
    )


def trailing_order_stats(
    df: DataFrame,
    keys: list[str],
    day: str,
    first_day: dt.date,
    last_day: dt.date,
    bits: Column,
    unit: Column,
    window: int = 60,
    median_dev: bool = True,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Order statistics over the days ``[d - window, d - 1]`` for each day ``d`` from first to last.

    ``wanted`` names the frames by ``keys`` and ``day``, where not all days are: a key with few rows then costs its frames, not
    the calendar.  ``df`` carries ``keys``, ``day`` and whole units ``v`` (see :func:`units`); ``bits`` is the band width and ``unit`` the units per value, which may depend on the keys.
    Days without any value in their frame are absent.
    """
    groups = [*keys, day]
    counted = df.filter(F.col("v").isNotNull()).groupBy(*groups, "v").agg(F.count(F.lit(1)).alias("c"))

    def framed(daily: DataFrame) -> DataFrame:
        """Counts and sums per key, day of interest and band.

        A daily record enters the frames on the next day and leaves them ``window`` days later: two changes, whatever
        the window.  Their running sums by day hold until the next change, and only those above zero become rows.
        """
        changes = daily.select(*keys, "band", F.explode(F.array(
            F.struct(F.date_add(day, 1).alias("at"), "c", "s"),
            F.struct(F.date_add(day, window + 1).alias("at"), (-F.col("c")).alias("c"), (-F.col("s")).alias("s")),
        )).alias("x")).groupBy(*keys, "band", F.col("x.at").alias("at")).agg(F.sum("x.c").alias("c"), F.sum("x.s").alias("s"))
        upto = Window.partitionBy(*keys, "band").orderBy("at")
        held = changes.select(
            *keys, "band", F.sum("c").over(upto).alias("c"), F.sum("s").over(upto).alias("s"),
            F.greatest("at", F.lit(first_day)).alias("from_day"),
            F.least(F.date_sub(F.lead("at").over(upto), 1), F.lit(last_day)).alias("to_day"),
        )
        held = held.filter("c > 0 AND from_day <= to_day")
        if wanted is None:
            return held.select(*keys, F.explode(F.sequence("from_day", "to_day")).alias(day), "band", "c", "s")
        # A span without a change is no longer than a frame, so it touches one or two blocks of days.
        spans = held.withColumn("block", F.explode(F.sequence(block(F.col("from_day")), block(F.col("to_day")))))
        asked = wanted.select(*groups).distinct().withColumn("block", block(F.col(day)))
        met = asked.join(spans, [*keys, "block"]).filter(F.col(day).between(F.col("from_day"), F.col("to_day")))
        return met.select(*groups, "band", "c", "s")

    def block(days) -> Column:
        return F.floor(F.unix_date(days) / window)

    counted = stage(_with_band(counted, bits), "counts")
    bands = framed(_bands(counted, groups))

    def fetch(chosen: DataFrame) -> DataFrame:
        values = counted.select(*keys, F.col(day).alias("on_day"), "band", "v", "c", block(F.col(day)).alias("block"))
        touched = F.sequence(block(F.date_sub(day, window)), block(F.date_sub(day, 1)))
        met = chosen.withColumn("block", F.explode(touched)).join(values.hint("merge"), [*keys, "band", "block"])
        framed = met.filter(F.col("on_day").between(F.date_sub(day, window), F.date_sub(day, 1)))
        return framed.groupBy(*chosen.columns, "v").agg(F.sum("c").alias("c"))  # equal values of all days are one

    return _in_values(_by_bands(bands, groups, fetch, bits, median_dev), groups, unit)

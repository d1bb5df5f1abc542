"""Sales anomalies: each recent fact row against its item's previous 60 days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketday.functions.scalar import robust_zscore, zscore
from marketday.operators.order_stats import band_bits, trailing_order_stats, units
from marketday.operators.rebuild import cutoff_date, in_window
from marketday.operators.trailing import daily_moments, sample_sd, trailing_moments

# Default window, days of history, flag threshold, grain and metric labels.
DEFAULT_DAYS = 30
HISTORY_DAYS = 60
THRESHOLD = 3
GRAIN = "ITEM"
METRICS = {"NET_SALES": "net_sales", "QUANTITY": "quantity"}
# --- end of fixed values ---

SCALE = 2  # digits of the mart's money


def _metric_rows(fact: DataFrame) -> DataFrame:
    """One row per fact row and metric, from one scan."""
    wide = fact.select(
        "date", "menu_item_id", "truck_brand_name", "country", "location_id",
        *[F.col(column).cast(f"decimal(38,{SCALE})").alias(name) for name, column in METRICS.items()],
    )
    return wide.unpivot(
        ["date", "menu_item_id", "truck_brand_name", "country", "location_id"],
        list(METRICS), "metric_name", "metric_value",
    )


def trailing_item_stats(
    fact: DataFrame, as_of: dt.date, days_back: int = DEFAULT_DAYS, as_written: bool = False,
) -> DataFrame:
    """Mean, deviation, median and spread of the 60 days before each recent (item, day), per metric.

    All locations of an item are pooled.  ``as_written=True`` reproduces the literal definition: the
    spread is the *mean* absolute deviation about the median, and every history row counts once per
    row of the scored (item, day), which only changes the sample deviation's divisor.  Otherwise
    the spread is the *median* absolute deviation and each history row counts once.
    """
    first = cutoff_date(as_of, days_back)
    base = fact.filter(in_window(F.col("date"), cutoff_date(as_of, days_back + HISTORY_DAYS)))
    # Three numbers about the slice: its last day and the value ranges.
    span = base.agg(
        F.max("date").alias("last"),
        *[F.max(F.abs(column)).alias(name) for name, column in METRICS.items()],
    ).first()
    last = max(span["last"] or as_of, first)
    rows = _metric_rows(base)
    keys = ["menu_item_id", "metric_name"]

    moments = trailing_moments(daily_moments(rows, keys, "date", "metric_value"), keys, "date", HISTORY_DAYS)
    copies = F.col("rows") if as_written else F.lit(1)
    spread = moments.filter(in_window(F.col("date"), first)).select(
        *keys, "date", "mean", sample_sd(copies * F.col("m2"), copies * F.col("n")).alias("sd")
    )

    # Quantities are whole numbers: their units need no digits after the point.
    scales = {name: 0 if name == "QUANTITY" else SCALE for name in METRICS}
    v = bits = unit = None
    for name, scale in scales.items():
        is_it = F.col("metric_name") == name
        wide = band_bits(0 if span[name] is None else span[name] * 10**scale)
        picks = (units(F.col("metric_value"), scale), F.lit(wide), F.lit(float(10**scale)))
        v, bits, unit = (
            F.when(is_it, p) if old is None else old.when(is_it, p) for old, p in zip((v, bits, unit), picks)
        )
    scored = rows.filter(in_window(F.col("date"), first)).select(*keys, "date")
    order = trailing_order_stats(
        rows.select(*keys, "date", v.alias("v")), keys, "date", first, last,
        bits, unit, HISTORY_DAYS, median_dev=not as_written, wanted=scored,
    )
    mad = "mean_abs_dev" if as_written else "median_abs_dev"
    # Merged: the stored facts are small for their number of rows, and Spark judges a side to broadcast by the files' size.
    return spread.hint("merge").join(order, [*keys, "date"]).select(
        *keys, "date", "n", "mean", "sd", "median", F.col(mad).alias("mad")
    )


def detect_anomalies(
    fact: DataFrame, as_of: dt.date, days_back: int = DEFAULT_DAYS, as_written: bool = False,
) -> DataFrame:
    """Score every fact row of the last ``days_back`` days on both metrics.

    ``fact`` should be a stored table: it is read for the value ranges, the statistics and the rows.
    Scores are not rounded here; writers round to the target's scale.  A missing score counts as 0.
    """
    stats = trailing_item_stats(fact, as_of, days_back, as_written)
    recent = _metric_rows(fact.filter(in_window(F.col("date"), cutoff_date(as_of, days_back))))
    scored = recent.join(stats.hint("merge"), ["menu_item_id", "metric_name", "date"], "left")
    value = F.col("metric_value")
    z, rz = zscore(value, F.col("mean"), F.col("sd")), robust_zscore(value, F.col("median"), F.col("mad"))

    def extreme(score):
        return F.abs(F.coalesce(score, F.lit(0.0))) >= THRESHOLD

    return scored.select(
        "date", F.lit(GRAIN).alias("grain"), F.col("menu_item_id").alias("id"), "metric_name",
        value.cast("decimal(38,2)").alias("metric_value"),
        z.alias("zscore"), rz.alias("robust_zscore"),
        (extreme(z) | extreme(rz)).alias("anomaly_flag"),
        F.to_json(  # fields that are NULL are left out of the object
            F.struct(
                F.col("truck_brand_name").alias("brand"), "country", F.col("location_id").alias("location")
            )
        ).alias("context"),
    )

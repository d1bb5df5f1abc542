"""The three checks of the daily item facts, one log row each."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketday.operators import checks
from marketday.operators.rebuild import cutoff_date, in_window

# Window, key and measure columns, check names, severity and notes.
DEFAULT_DAYS = 7
REQUIRED_KEYS = ["menu_item_id", "location_id"]
MEASURES = ["quantity", "gross_sales", "net_sales"]
UNIQUE_KEY = ["date", "menu_item_id", "location_id"]
SEVERITY = "ERROR"
NOTES = {
    "FACT_NULL_KEYS": "menu_item_id/location_id should not be NULL",
    "FACT_NON_NEGATIVE": "quantity, gross_sales, net_sales must be >= 0",
    "FACT_DUPLICATES": "Duplicate rows at (date, menu_item_id, location_id)",
}
NO_SAMPLE = '{"sample_rows":[]}'
# --- end of fixed values ---


def write_counts() -> checks.WriteCounts:
    """The three counts, taken while fact rows are written."""
    return checks.WriteCounts(UNIQUE_KEY, no_key=checks.any_null(REQUIRED_KEYS), negative=checks.any_negative(MEASURES))


def fact_checks_from(found: dict[str, int], fact: DataFrame, as_of: dt.date, days_back: int = DEFAULT_DAYS) -> DataFrame:
    """The log rows of counts that are known from the write; the table is read only where there are rows to show."""
    counts = fact.sparkSession.range(1).select(*[F.lit(n).cast("bigint").alias(name) for name, n in found.items()])
    if found["no_key"] == 0:
        return _log(counts, F.lit(NO_SAMPLE))
    window = fact.filter(in_window(F.col("date"), cutoff_date(as_of, days_back)))
    return _log(counts, checks.sample_json(window, checks.any_null(REQUIRED_KEYS), window.columns).scalar())


def fact_checks(fact: DataFrame, as_of: dt.date, days_back: int = DEFAULT_DAYS) -> DataFrame:
    """Check the window of the fact table; rows as the log table takes them, without the run time.

    One grouping by the unique key gives all three counts: failing rows add up over the groups, and a group of
    several rows is a duplicate (duplicates count *groups*).  The sample is a top ten of the same window.
    """
    window = fact.filter(in_window(F.col("date"), cutoff_date(as_of, days_back)))
    no_key = checks.any_null(REQUIRED_KEYS)
    by_key = window.groupBy(*UNIQUE_KEY).agg(
        F.count(F.lit(1)).alias("rows"),
        checks.failing(no_key).alias("no_key"),
        checks.failing(checks.any_negative(MEASURES)).alias("negative"),
    )
    counts = by_key.agg(
        F.coalesce(F.sum("no_key"), F.lit(0)).alias("no_key"), F.coalesce(F.sum("negative"), F.lit(0)).alias("negative"),
        F.count_if(F.col("rows") > 1).alias("twice"),
    )
    return _log(counts, checks.sample_json(window, no_key, window.columns).scalar())


def _log(counts: DataFrame, sample: Column) -> DataFrame:
    def entry(check, failed, sample=None):
        return checks.result(check, SEVERITY, NOTES[check], failed, sample)

    return checks.log_rows(
        counts, entry("FACT_NULL_KEYS", "no_key", sample), entry("FACT_NON_NEGATIVE", "negative"), entry("FACT_DUPLICATES", "twice")
    )

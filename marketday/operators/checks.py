"""Generic data-quality checks over any table.

Counting is a single aggregation; only a handful of failing rows are ever shown, and those are
picked in key order so that two runs show the same ones.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 10  # fixed value


def any_null(keys: list[str]) -> Column:
    return reduce(or_, [F.col(k).isNull() for k in keys])


def any_negative(columns: list[str]) -> Column:
    return reduce(or_, [F.col(c) < 0 for c in columns])


def failing(condition: Column) -> Column:
    """Number of rows for which the condition holds (NULL does not)."""
    return F.count_if(condition)


def sample_json(df: DataFrame, condition: Column, order_by: list[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """One row: the first failing rows as a JSON object; NULL fields are left out."""
    picked = df.filter(condition).orderBy(*order_by).limit(n)
    return picked.agg(
        F.to_json(F.struct(F.collect_list(F.struct("*")).alias("sample_rows"))).alias("sample_rows")
    )


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many key values occur more than once."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        .agg(F.count(F.lit(1)).alias("failed_count"))
    )


class WriteCounts:
    """Failing rows counted by the job that writes them.

    ``prepare`` marks one row of every group of rows with the same key, where the group has several.  ``watch`` belongs
    right before the write, after the last shuffle: a task of the last stage that runs again is then counted once,
    whereas one of an earlier stage would be counted each time.  ``found`` waits for the end of the write.
    """

    MARK = "_second_of_its_key"

    def __init__(self, unique_key: list[str], **conditions: Column):
        self.unique_key, self.conditions, self._seen = unique_key, conditions, Observation()

    def prepare(self, df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c not in self.unique_key]
        order = Window.partitionBy(*self.unique_key).orderBy(*(others or self.unique_key))
        return df.withColumn(self.MARK, F.row_number().over(order) == 2)

    def watch(self, df: DataFrame) -> DataFrame:
        counts = {name: failing(c) for name, c in self.conditions.items()} | {"twice": F.count_if(self.MARK)}
        return df.observe(self._seen, *[c.alias(name) for name, c in counts.items()])

    def found(self) -> dict[str, int]:
        seen = self._seen.get
        return {name: seen.get(name) or 0 for name in [*self.conditions, "twice"]}


def result(
    check: str, severity: str, notes: str, failed: str = "failed_count", sample: Column | None = None
) -> Column:
    """One log entry made from a column that counts failures."""
    return F.struct(
        F.lit(check).alias("check_name"),
        F.lit(severity).alias("severity"),
        F.when(F.col(failed) == 0, "PASS").otherwise("FAIL").alias("status"),
        F.col(failed).alias("failed_count"),
        (F.lit(None).cast("string") if sample is None else sample).alias("sample_rows"),
        F.lit(notes).alias("notes"),
    )


def log_rows(counts: DataFrame, *results: Column) -> DataFrame:
    """Log rows from a one-row frame of counts, which is computed once."""
    return counts.select(F.inline(F.array(*results)))

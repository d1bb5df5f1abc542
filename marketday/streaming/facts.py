"""The daily fact mart fed by file drops: a run loads the new files and rebuilds the days that they touch, no others."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketday.operators.snapshots import SnapshotTable
from marketday.plans import marts
from marketday.plans.daily_run import now_column, shaped
from marketday.plans.views import Tables, orders_v
from marketday.session import exists
from marketday.sources.loads import CSV_OPTIONS
from marketday.sources.schemas import MART, RAW

SOURCES = ("order_header", "order_detail")


class FactFeed:
    """Order headers and lines from ``inbox/<source>/`` CSV folders to the fact mart below ``root``.

    A file stream for each source takes every file once and appends its rows to ``root/raw/<source>/run=<number>``.
    How many runs the mart holds is committed with the mart's days, in one file, so a run that ends anywhere is
    made good by the next one: files loaded but not yet in the mart carry a number above the committed one, and rows that
    are in the mart are not taken again.  As for any stream with a checkpoint, one feed runs at a time.

    A day is touched by new headers of that day and by new lines of its orders, however late either of them comes; lines
    wait for their header.  Touched days are computed again from all rows, as distinct orders do not add up.
    ``tables`` holds the dimensions; a change in them touches no day and needs a rebuild (``DailyRun``, on the same root).
    """

    def __init__(self, spark: SparkSession, tables: Tables, inbox: str, root: str):
        self.spark, self.dimensions, self.inbox, self.root = spark, tables, inbox, root
        # shuffle files of a finished job are of no further use: every later step reads what was written
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        self.mart = SnapshotTable(spark, f"{root}/fact_daily_item_sales", MART["fact_daily_item_sales"])

    def load(self, source: str, number: int, **options: str) -> None:
        """Append the new files of a source as rows of this run."""
        stream = (
            self.spark.readStream.schema(RAW[source]).options(**{**CSV_OPTIONS, **options}).csv(f"{self.inbox}/{source}")
            .withColumn("run", F.lit(number))
            .writeStream.format("parquet").option("compression", "zstd").partitionBy("run").option("path", f"{self.root}/raw/{source}")
            .option("checkpointLocation", f"{self.root}/state/{source}").outputMode("append").trigger(availableNow=True).start()
        )
        stream.awaitTermination()

    def raw(self, source: str) -> DataFrame:
        """All loaded rows, with the run that loaded them; read through the sink's own log, so no half-written file counts."""
        schema, path = f"{RAW[source]}, run int", f"{self.root}/raw/{source}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def tables(self) -> Tables:
        """Dimensions and loaded orders, as ``DailyRun`` takes them."""
        return {**self.dimensions, **{s: self.raw(s).drop("run") for s in SOURCES}}

    def run(self, **options: str) -> int:
        """Load what is new and bring the mart up to date; fact rows written.  Without new rows nothing is committed."""
        number = self.mart.note().get("runs", 0) + 1
        for source in SOURCES:
            self.load(source, number, **options)
        return self.fold(number)

    def fold(self, number: int) -> int:
        """Rebuild the days touched by the rows of a run; nothing happens where the mart holds that run already."""
        seen = self.mart.note()
        if number <= seen.get("runs", 0):
            return 0
        header, lines = self.raw("order_header"), self.raw("order_detail")
        fresh_lines = lines.filter(F.col("run") == number).select("order_id")
        moved = header.filter(F.col("run") == number).select("order_ts").unionByName(
            header.join(fresh_lines, "order_id", "left_semi").select("order_ts")
        )
        days = {r[0] for r in moved.select(F.to_date("order_ts")).distinct().collect()}  # at most the days of the calendar
        if not days and lines.filter(F.col("run") == number).isEmpty():
            return 0
        recent = of_days(header, days).drop("run")
        # a first load is of all orders, whose lines would be shuffled for each dimension
        orders = orders_v(self.dimensions, recent, marts.lines_between(lines.drop("run"), recent), most=True)
        rows = shaped(marts.daily_item_sales(orders), "fact_daily_item_sales", last_updated_at=now_column())
        return self.mart.replace(rows, days, {"runs": number}, seen)


def of_days(header: DataFrame, days: set[dt.date | None]) -> DataFrame:
    """Headers of these days (None: without a time).  The outermost days are a range on the raw timestamp, for the scan."""
    ts, dated = F.col("order_ts"), sorted(d for d in days if d is not None)
    keep = ts.isNull() if None in days else F.lit(False)
    if dated:
        inside = (ts >= F.lit(dated[0])) & (ts < F.lit(dated[-1] + dt.timedelta(days=1)))
        keep = keep | (inside & F.to_date(ts).isin(dated))
    return header.filter(keep)

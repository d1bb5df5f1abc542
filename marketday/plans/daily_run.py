"""The daily run: facts, brand KPIs, checks and anomalies, one after the other, with a run log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketday.functions.text import STATEMENT_CHARS
from marketday.operators.checks import WriteCounts
from marketday.operators.rebuild import cutoff_date, in_window
from marketday.operators.snapshots import SnapshotTable, is_snapshot
from marketday.plans import anomalies, marts, quality
from marketday.plans.views import Tables
from marketday.session import drop_path, exists, scratch_path
from marketday.sources.schemas import MART

# What each step reports.
MESSAGES = {
    "build_fact": "fact_daily_item_sales built for last {} days",
    "build_kpi": "kpi_daily_brand built for last {} days",
    "run_checks": "DQ checks executed for last {} days",
    "detect": "Anomalies detected for last {} days",
}
# --- end of fixed values ---

WINDOW_MARTS = ("fact_daily_item_sales", "kpi_daily_brand", "sales_anomalies")
RUN_LOG = "step string, success boolean, rows_affected bigint, error string, message string, run_ts timestamp_ntz"


def now_column():
    return F.current_timestamp().cast("timestamp_ntz")


def read_mart(spark: SparkSession, root: str, name: str, since: dt.date | None = None) -> DataFrame:
    """A mart or log table below ``root``; empty while nothing has been committed.

    Of a mart its newest version; ``since`` leaves earlier days unlisted.  A folder that does not hold the declared columns
    is an error.
    """
    schema, path = MART[name] if name in MART else RUN_LOG, f"{root}/{name}"
    if is_snapshot(spark, path):
        return SnapshotTable(spark, path, schema).read(since=since)
    if not exists(spark, path) or exists(spark, f"{path}/data"):
        return spark.createDataFrame([], schema)
    lost = set(StructType.fromDDL(schema).fieldNames()) - set(spark.read.parquet(path).columns)
    if lost:
        raise ValueError(f"{path} has no column {', '.join(sorted(lost))}")
    return spark.read.schema(schema).parquet(path)


def shaped(df: DataFrame, name: str, **defaults) -> DataFrame:
    """The columns of a mart table in its types; columns the rows do not carry take a default."""
    for column, value in defaults.items():
        df = df.withColumn(column, value)
    fields = StructType.fromDDL(MART[name]).fields
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


class DailyRun:
    """The four steps over one mart folder and one as-of date.

    Every step may be repeated: window tables are rebuilt from the orders as they are then, the log grows.  Each rebuild is a
    version of its table, so readers see the one before or the one after; :meth:`tidy` removes older ones.  Within
    one ``run`` the order lines of the window are joined once, staged in the shared folder, used by the fact and
    the KPI step, and dropped; the checks' counts are taken while the facts are written.
    """

    def __init__(self, spark: SparkSession, tables: Tables, root: str, as_of: dt.date):
        self.spark, self.tables, self.root, self.as_of = spark, tables, root, as_of
        self._staged: dict[int, str] | None = None  # only during a run
        self._found: dict[int, dict[str, int]] = {}  # what this run's write of the facts has counted

    def orders(self, days_back: int) -> DataFrame:
        needed = marts.window_orders(self.tables, self.as_of, days_back).select(
            "order_id", "order_ts", "menu_item_id", "menu_item_name", "truck_brand_name", "country",
            "location_id", "customer_id", "quantity", "price",
        )
        if self._staged is None:
            return needed
        if days_back not in self._staged:
            self._staged[days_back] = scratch_path(self.spark, "window-orders")
            needed.write.parquet(self._staged[days_back])
        return self.spark.read.schema(needed.schema).parquet(self._staged[days_back])

    def facts(self, days_back: int) -> DataFrame:
        """The days of the fact table that a step looks at; the table must have been built."""
        if not exists(self.spark, f"{self.root}/fact_daily_item_sales"):
            raise FileNotFoundError(f"no facts below {self.root}: build_fact comes first")
        return read_mart(self.spark, self.root, "fact_daily_item_sales", cutoff_date(self.as_of, days_back))

    def mart(self, name: str) -> DataFrame:
        return read_mart(self.spark, self.root, name)

    def snapshots(self, name: str) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.root}/{name}", MART[name])

    def tidy(self, keep: int = 2) -> int:
        """Remove what only older versions hold; folders removed.  Not while a run writes."""
        return sum(self.snapshots(name).expire(keep) for name in WINDOW_MARTS)

    def _rebuild(self, rows: DataFrame, name: str, days_back: int, stamp: str, counts: WriteCounts | None = None) -> int:
        rows = shaped(rows, name, **{stamp: now_column()})
        table = self.snapshots(name)
        if exists(self.spark, table.path) and not is_snapshot(self.spark, table.path) and not exists(self.spark, f"{table.path}/data"):
            table.rebuild(read_mart(self.spark, self.root, name), None)  # a table of day folders becomes the first version
        cutoff = cutoff_date(self.as_of, days_back)
        return table.rebuild(counts.prepare(rows), cutoff, counts.watch) if counts else table.rebuild(rows, cutoff)

    def build_fact(self, days_back: int = marts.DEFAULT_DAYS) -> int:
        rows = marts.daily_item_sales(self.orders(days_back))
        if self._staged is None:
            return self._rebuild(rows, "fact_daily_item_sales", days_back, "last_updated_at")
        counts = quality.write_counts()
        written = self._rebuild(rows, "fact_daily_item_sales", days_back, "last_updated_at", counts)
        self._found[days_back] = counts.found()
        return written

    def build_kpi(self, days_back: int = marts.DEFAULT_DAYS, per_line: bool = False) -> int:
        rows = marts.build_kpi(
            self.facts(days_back), self.orders(days_back), self.as_of, days_back, per_line
        )
        return self._rebuild(rows, "kpi_daily_brand", days_back, "last_updated_at")

    def run_checks(self, days_back: int = quality.DEFAULT_DAYS) -> int:
        facts = self.facts(days_back)
        if days_back in self._found:
            rows = quality.fact_checks_from(self._found[days_back], facts, self.as_of, days_back)
        else:
            rows = quality.fact_checks(facts, self.as_of, days_back)
        path, own = f"{self.root}/dq_results", scratch_path(self.spark, "checks")
        shaped(rows, "dq_results", run_ts=now_column()).write.parquet(own)
        rows = self.spark.read.schema(MART["dq_results"]).parquet(own)
        rows.write.mode("append").parquet(path)
        found = rows.count()
        drop_path(self.spark, own)
        return found

    def detect(self, days_back: int = anomalies.DEFAULT_DAYS, as_written: bool = False) -> int:
        rows = anomalies.detect_anomalies(
            self.facts(days_back + anomalies.HISTORY_DAYS), self.as_of, days_back, as_written
        )
        return self._rebuild(rows, "sales_anomalies", days_back, "detected_at")

    def run(self, days_back: int = marts.DEFAULT_DAYS) -> DataFrame:
        """All steps in order; the log rows of this run.  A failing step is logged and ends the run."""
        steps = [
            ("build_fact", self.build_fact, days_back),
            ("build_kpi", self.build_kpi, days_back),
            ("run_checks", self.run_checks, days_back),
            ("detect", self.detect, max(days_back, anomalies.DEFAULT_DAYS)),
        ]
        log, failure, self._staged, self._found = [], None, {}, {}
        for name, step, days in steps:
            try:
                log.append((name, True, step(days), "", MESSAGES[name].format(days)))
            except Exception as error:  # noqa: BLE001 - logged, then raised below
                failure = error
                log.append((name, False, 0, str(error)[:STATEMENT_CHARS], ""))
                break
        for path in self._staged.values():
            drop_path(self.spark, path)
        self._staged, self._found = None, {}
        columns = ("step", "success", "rows_affected", "error", "message")
        entries = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in log])
        rows = self.spark.range(1).select(F.inline(entries)).withColumn("rows_affected", F.col("rows_affected").cast("bigint"))
        rows = rows.withColumn("run_ts", now_column())
        rows.write.mode("append").parquet(f"{self.root}/run_log")
        if failure is not None:
            raise failure
        return rows

    def recent(self, name: str, days_back: int) -> DataFrame:
        """The window of a mart table."""
        since = cutoff_date(self.as_of, days_back)
        return read_mart(self.spark, self.root, name, since).filter(in_window(F.col("date"), since))

"""Writers: replace a table, append to one, export a header CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Create or replace a Parquet table from a query."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Header CSV, one file per task; quotes inside a field are doubled."""
    df.write.mode("overwrite").options(header="true", escape='"', emptyValue="").csv(path)

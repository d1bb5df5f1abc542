"""Re-runnable folder loads: each run takes the files that no earlier run has taken."""

from __future__ import annotations

from pyspark.sql import SparkSession

from marketday.session import exists
from marketday.sources.loads import CSV_OPTIONS


def load_new_csv(
    spark: SparkSession, source: str, schema: str, table: str, state: str, **options: str
) -> int:
    """Append the new CSV files of a folder to a Parquet table; rows added by this run.

    A file stream that stops when it has caught up.  Taken files are remembered in the ``state``
    folder, and the Parquet sink commits each batch once, so a run that is repeated after a failure
    adds nothing twice.  Read the table through Spark, which honours the sink's commit log.
    """
    def rows() -> int:  # from the files' footers, of committed batches only
        return spark.read.schema(schema).parquet(table).count() if exists(spark, table) else 0

    before = rows()
    stream = (
        spark.readStream.schema(schema).options(**{**CSV_OPTIONS, **options}).csv(source)
        .writeStream.format("parquet").option("path", table).option("checkpointLocation", state)
        .outputMode("append").trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    return rows() - before

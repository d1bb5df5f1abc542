"""Readers: typed CSV loads, header CSV, JSON kept in a column, whole files, file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketday.sources.schemas import RAW

# Bulk CSV files have no header; a quote inside a quoted field is doubled.
CSV_OPTIONS = {"header": "false", "quote": '"', "escape": '"', "mode": "FAILFAST"}


def load_csv(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """Typed load of a folder of CSV files; a value that does not fit its type fails the load."""
    return spark.read.schema(schema).options(**{**CSV_OPTIONS, **options}).csv(path)


def load_raw(spark: SparkSession, root: str, **options: str) -> dict[str, DataFrame]:
    """The nine raw tables from ``root/<table>/`` folders of CSV files."""
    return {name: load_csv(spark, f"{root}/{name}", schema, **options) for name, schema in RAW.items()}


def store_raw(tables: dict[str, DataFrame], root: str) -> None:
    """Write loaded tables as Parquet below ``root``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def open_raw(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The stored raw tables."""
    return {name: spark.read.schema(schema).parquet(f"{root}/{name}") for name, schema in RAW.items()}


def with_variant(df: DataFrame, column: str) -> DataFrame:
    """Parse a JSON text column into a variant; text that is not JSON becomes NULL."""
    return df.withColumn(column, F.try_parse_json(column))


def load_relations(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV of relations: the header names the columns, every field is a string."""
    return spark.read.option("header", "true").option("escape", '"').csv(path)


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as ``name, content, folder`` (its last part); bytes that are not UTF-8 are replaced."""
    return (
        spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        .select(
            F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("name"),
            F.make_valid_utf8("value").alias("content"),
            F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("folder"),
        )
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and time of every file below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "length", "modificationTime")
    )

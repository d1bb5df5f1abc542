"""Measured column dictionaries and inventories of code files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketday.functions.text import language_label


SKETCH_K = 12  # 2^12 registers: a relative standard error of 1.6 % for a distinct count
ERROR = 0.05  # three of them


def _hashes(df: DataFrame) -> list[Column]:
    """Per column 128 bits that stand for its value, null for NULL.  0.0 and -0.0 are one value."""
    out = []
    for field in df.schema.fields:
        kind, col = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind in ("double", "float"):
            value = col + 0.0
        else:  # of these types no hash is defined
            value = col.cast("string") if kind.startswith(("map", "variant", "interval")) else col
        out.append(F.when(col.isNotNull(), F.struct(F.xxhash64(value).alias("h1"), F.xxhash64(F.lit("second"), value).alias("h2"))))
    return out


def _described(table: str, measured: DataFrame, fields) -> DataFrame:
    """``measured`` (i and figures of column i) with the table's and the column's names and types."""
    def named(values: list) -> Column:
        return F.array(*[F.lit(v) for v in values])[F.col("i")]

    figures = [c for c in measured.columns if c != "i"]
    return measured.select(
        F.lit(table).alias("table_name"),
        (F.col("i") + 1).alias("position"),
        named([f.name for f in fields]).alias("column_name"),
        named([f.dataType.simpleString() for f in fields]).alias("data_type"),
        named([f.nullable for f in fields]).alias("nullable"),
        *figures,
    )


def column_dictionary(table: str, df: DataFrame) -> DataFrame:
    """One row per column: position, type, nullability, and measured rows, NULLs and distinct values.

    One scan and one grouping: (position, 128-bit hash of the value) with its count, which combines on the map side
    and spreads every column over all tasks.  Of 2^32 different values two would share a hash with a chance of 2^-65; no
    value itself is moved.
    """
    fields = df.schema.fields
    hashed = df.select(F.posexplode(F.array(*_hashes(df))).alias("i", "v"))
    values = hashed.groupBy("i", "v.h1", "v.h2").agg(F.count(F.lit(1)).alias("c"))
    absent = F.col("h1").isNull()
    measured = values.groupBy("i").agg(
        F.sum("c").alias("row_count"),
        F.coalesce(F.sum(F.when(absent, F.col("c"))), F.lit(0)).alias("null_count"),
        F.count(F.when(~absent, 1)).alias("distinct_count"),
    )
    none = df.sparkSession.range(len(fields)).select(F.col("id").cast("int").alias("i"))  # an empty table has columns too
    measured = none.join(measured, "i", "left").fillna(0, ["row_count", "null_count", "distinct_count"])
    return _described(table, measured, fields)


def column_sketches(table: str, df: DataFrame, load: str) -> DataFrame:
    """What one load adds to a table's dictionary: rows, NULLs and a mergeable sketch of the distinct values per column.

    One pass; what is shuffled is one sketch of some kilobytes per column and task, whatever the number of values.
    """
    fields = df.schema.fields
    parts = [
        F.struct(
            F.lit(i).alias("i"), F.count(F.lit(1)).alias("row_count"), F.count(F.when(h.isNull(), 1)).alias("null_count"),
            F.hll_sketch_agg(h["h1"], F.lit(SKETCH_K)).alias("sketch"),
        )
        for i, h in enumerate(_hashes(df))
    ]
    measured = df.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))
    return _described(table, measured, fields).withColumn("load", F.lit(load))


def merged_dictionary(sketches: DataFrame) -> DataFrame:
    """The dictionary of all loads from their stored sketches: no row is read again; distinct counts are estimates.

    An estimate is off by more than ERROR of the count about three times in a thousand.  Loads may overlap in values, not in rows.
    """
    keys = ["table_name", "position", "column_name", "data_type", "nullable"]
    return sketches.groupBy(*keys).agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"),
    )


def column_dictionaries(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [column_dictionary(name, df) for name, df in tables.items()])


def corpus_inventory(files: DataFrame) -> DataFrame:
    """Per code file (``name, content``): language, number of characters and its header line."""
    language = language_label(F.col("name"))
    return files.select(
        "name",
        language.alias("language"),
        F.length("content").alias("chars"),
        F.concat(F.lit("FILE: "), F.col("name"), F.lit(" (language: "), language, F.lit(")")).alias("header"),
    )

"""Object (struct) columns: build from columns, repair a field under a condition, drop the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build_object(df: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """Add a struct column made of existing columns."""
    return df.withColumn(name, F.struct(*fields))


def set_field_where(df: DataFrame, name: str, field: str, value, condition: Column) -> DataFrame:
    """Replace one field of a struct column where the condition holds, keep the column elsewhere."""
    obj = F.col(name)
    return df.withColumn(name, F.when(condition, obj.withField(field, F.lit(value))).otherwise(obj))


def object_text(col) -> Column:
    """The object as JSON text; fields that are NULL are left out."""
    return F.to_json(col)


def truck_details(trucks: DataFrame, bad: str = "Ford_", good: str = "Ford") -> DataFrame:
    """Trucks with year, make and model folded into one object, the make repaired for even ids.

    Only every second truck is repaired: the data is meant to stay messy (fixed rule and values).
    """
    parts = ["year", "make", "model"]
    built = build_object(trucks, "truck_build", parts)
    wrong = (F.col("truck_build.make") == bad) & (F.col("truck_id") % 2 == 0)
    return set_field_where(built, "truck_build", "make", good, wrong).drop(*parts)

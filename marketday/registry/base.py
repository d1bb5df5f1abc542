"""How a job becomes a registered query: the session is tuned and the output made comparable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketday.session import own_folder, stage, tune
from marketday.sources import standin

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Output types every SQL engine prints alike: integers as bigint, decimals as double, dates as text."""
    cols = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DecimalType, T.FloatType)):
            col = col.cast("double")
        elif isinstance(kind, (T.IntegerType, T.ShortType)):
            col = col.cast("bigint")
        elif isinstance(kind, T.DateType):
            col = col.cast("string")
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        cols.append(col.alias(field.name))
    return df.select(*cols)


class Registry:
    """Queries and their oracle SQL by name."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(fn: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                own_folder(spark)
                return plain(fn(tune(spark), sf_dir))

            run.__name__, run.__doc__ = name, fn.__doc__
            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return standin.read(spark, sf_dir, name)


def roles(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return standin.RoleTables(spark, sf_dir)


def brand_fact(fact: DataFrame) -> DataFrame:
    """Daily facts with the brand as the item: a series dense enough for trailing statistics."""
    brand = F.col("truck_brand_name")
    return fact.groupBy(
        "date", brand.alias("menu_item_id"), brand.alias("menu_item_name"), "truck_brand_name", "country",
        "location_id",
    ).agg(*[F.sum(c).alias(c) for c in ("orders_count", "order_lines", "quantity", "gross_sales", "net_sales")])


def stored(df: DataFrame) -> DataFrame:
    """A mart as a job finds it: written, and read back."""
    return stage(df, "mart")


SLIVER = 0.0000012345678


def shown(col, digits: int = 4):
    """A computed value to a few digits; the sliver keeps exact ties off the rounding edge, where the
    order of a floating point sum would decide."""
    return F.round(F.col(col) + SLIVER if isinstance(col, str) else col + SLIVER, digits)


def shown_sql(expr: str, digits: int = 4) -> str:
    return f"round({expr} + {SLIVER:.13f}, {digits})"


AS_OF = "(SELECT max(CAST(o_orderdate AS DATE)) FROM orders)"

FACT_SQL = """,
fact AS (
  SELECT date, CAST(menu_item_id AS VARCHAR) AS menu_item_id, menu_item_name, truck_brand_name, country,
         CAST(location_id AS VARCHAR) AS location_id,
         count(DISTINCT order_id) AS orders_count, count(*) AS order_lines,
         CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(price) AS DECIMAL(38,2)) AS gross_sales,
         CAST(sum(price) AS DECIMAL(38,2)) AS net_sales
  FROM orders_v GROUP BY ALL),
brand_fact AS (
  SELECT date, truck_brand_name AS menu_item_id, truck_brand_name AS menu_item_name, truck_brand_name,
         country, location_id, CAST(sum(orders_count) AS BIGINT) AS orders_count,
         CAST(sum(order_lines) AS BIGINT) AS order_lines, CAST(sum(quantity) AS BIGINT) AS quantity,
         sum(gross_sales) AS gross_sales, sum(net_sales) AS net_sales
  FROM fact GROUP BY ALL)
"""


def with_fact(sql: str) -> str:
    """An oracle query over the role tables and the daily facts."""
    return standin.with_roles(FACT_SQL + " " + sql)


with_roles = standin.with_roles

"""Role tables built from the TPC-H-like test tables.

The warehouse's own sample files are not available, so each of its raw tables is a projection of a
test table: lines, orders, suppliers (trucks), parts (menu items), nations (franchises and
locations), one customer segment (loyalty members) and documents (reviews).  Columns without a
counterpart are NULL.  ``ROLE_SQL`` says the same in SQL for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketday.sources.schemas import RAW

# The test tables' columns and types.  Stating them saves a look at a file footer per table.
TEST_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TEST_TABLES = tuple(TEST_SCHEMAS)
MEMBER_SEGMENT = "BUILDING"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TEST_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _conform(df: DataFrame, role: str, **cols: Column) -> DataFrame:
    fields = StructType.fromDDL(RAW[role]).fields
    return df.select(
        *[(cols[f.name] if f.name in cols else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


class RoleTables(dict):
    """The nine raw tables over one test folder; each is set up when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, role: str) -> DataFrame:
        self[role] = getattr(self, f"_{role}")()
        return self[role]

    def _read(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)

    @cached_property
    def n_trucks(self) -> int:
        return self._read("supplier").count()  # from the file footer

    @cached_property
    def n_places(self) -> int:
        return self._read("nation").count()

    def _places(self) -> DataFrame:
        return self._read("nation").join(self._read("region"), F.col("n_regionkey") == F.col("r_regionkey"))

    def _order_header(self) -> DataFrame:
        c = F.col
        return _conform(
            self._read("orders"), "order_header",
            order_id=c("o_orderkey"), truck_id=c("o_custkey") % self.n_trucks,
            location_id=c("o_orderkey") % self.n_places, customer_id=c("o_custkey"),
            order_channel=c("o_orderpriority"), order_ts=c("o_orderdate"),
            order_amount=c("o_totalprice"), order_tax_amount=c("o_orderkey") % 9,
            order_discount_amount=c("o_custkey") % 5, order_total=c("o_totalprice"),
        )

    def _order_detail(self) -> DataFrame:
        c, price = F.col, F.col("l_extendedprice")
        return _conform(
            self._read("lineitem"), "order_detail",
            order_detail_id=c("l_orderkey") * 8 + c("l_linenumber"), order_id=c("l_orderkey"),
            menu_item_id=c("l_partkey"), line_number=c("l_linenumber"), quantity=c("l_quantity"),
            unit_price=F.floor(price * 100 / c("l_quantity")) / 100, price=price,
            order_item_discount_amount=c("l_discount"),
        )

    def _truck(self) -> DataFrame:
        c = F.col
        return _conform(
            self._read("supplier").join(self._places(), c("s_nationkey") == c("n_nationkey")), "truck",
            truck_id=c("s_suppkey"), menu_type_id=c("s_suppkey") % 50 + 1, primary_city=c("s_name"),
            region=c("n_name"), country=c("r_name"), franchise_flag=F.lit(1), franchise_id=c("s_nationkey"),
        )

    def _menu(self) -> DataFrame:
        c = F.col
        return _conform(
            self._read("part"), "menu",
            menu_id=c("p_partkey"), menu_type_id=c("p_size"), menu_type=c("p_type"),
            truck_brand_name=c("p_brand"), menu_item_id=c("p_partkey"), menu_item_name=c("p_name"),
            sale_price_usd=c("p_retailprice"),
        )

    def _franchise(self) -> DataFrame:
        c = F.col
        return _conform(
            self._read("nation"), "franchise",
            franchise_id=c("n_nationkey"), first_name=c("n_name"),
            last_name=F.concat(F.lit("Owner "), c("n_nationkey")),
        )

    def _location(self) -> DataFrame:
        c = F.col
        return _conform(
            self._places(), "location", location_id=c("n_nationkey"), location=c("n_name"), country=c("r_name")
        )

    def _country(self) -> DataFrame:
        c = F.col
        return _conform(self._read("region"), "country", country_id=c("r_regionkey"), country=c("r_name"))

    def _customer_loyalty(self) -> DataFrame:
        c = F.col
        return _conform(
            self._read("customer").filter(c("c_mktsegment") == MEMBER_SEGMENT), "customer_loyalty",
            customer_id=c("c_custkey"), first_name=c("c_name"), last_name=c("c_mktsegment"),
            city=F.concat(F.lit("CITY_"), c("c_nationkey")),
            country=F.concat(F.lit("COUNTRY_"), c("c_nationkey") % 5),
            gender=F.when(c("c_custkey") % 2 == 0, "F").otherwise("M"),
            marital_status=F.when(c("c_nationkey") < 9, "Single").otherwise("Married"),
            children_count=c("c_nationkey") % 4,
            e_mail=F.concat(c("c_name"), F.lit("@example.com")),
            phone_number=F.concat(F.lit("555-"), c("c_custkey")),
        )

    def _truck_reviews(self) -> DataFrame:
        c = F.col
        return _conform(
            self._read("documents"), "truck_reviews",
            order_id=c("doc_id"), language=c("lang"), source=c("source"), review=c("text"), review_id=c("doc_id"),
        )


def latest_order_date(tables: dict[str, DataFrame]):
    """The newest order's date: one number from a one-column aggregate."""
    return tables["order_header"].agg(F.to_date(F.max("order_ts")).alias("d")).first()["d"]


ROLE_SQL = f"""
order_header AS (
  SELECT o_orderkey AS order_id, o_custkey % (SELECT count(*) FROM supplier) AS truck_id,
         CAST(o_orderkey % (SELECT count(*) FROM nation) AS DOUBLE) AS location_id,
         o_custkey AS customer_id, o_orderpriority AS order_channel, o_orderdate AS order_ts,
         CAST(o_totalprice AS DECIMAL(18,4)) AS order_amount,
         CAST(o_orderkey % 9 AS VARCHAR) AS order_tax_amount,
         CAST(o_custkey % 5 AS VARCHAR) AS order_discount_amount,
         CAST(o_totalprice AS DECIMAL(18,4)) AS order_total
  FROM orders),
order_detail AS (
  SELECT l_orderkey * 8 + l_linenumber AS order_detail_id, l_orderkey AS order_id,
         l_partkey AS menu_item_id, CAST(l_linenumber AS BIGINT) AS line_number,
         CAST(l_quantity AS BIGINT) AS quantity,
         CAST(floor(l_extendedprice * 100 / l_quantity) / 100 AS DECIMAL(18,4)) AS unit_price,
         CAST(l_extendedprice AS DECIMAL(18,4)) AS price
  FROM lineitem),
truck AS (
  SELECT s_suppkey AS truck_id, s_suppkey % 50 + 1 AS menu_type_id, s_name AS primary_city,
         n_name AS region, r_name AS country, 1 AS franchise_flag, s_nationkey AS franchise_id
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
menu AS (
  SELECT p_size AS menu_type_id, p_type AS menu_type, p_brand AS truck_brand_name,
         p_partkey AS menu_item_id, p_name AS menu_item_name
  FROM part),
franchise AS (
  SELECT n_nationkey AS franchise_id, n_name AS first_name, 'Owner ' || n_nationkey AS last_name
  FROM nation),
location AS (SELECT n_nationkey AS location_id FROM nation),
customer_loyalty AS (
  SELECT c_custkey AS customer_id, c_name AS first_name, c_mktsegment AS last_name,
         'CITY_' || c_nationkey AS city, 'COUNTRY_' || c_nationkey % 5 AS country,
         CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
         CASE WHEN c_nationkey < 9 THEN 'Single' ELSE 'Married' END AS marital_status,
         CAST(c_nationkey % 4 AS VARCHAR) AS children_count,
         c_name || '@example.com' AS e_mail, '555-' || c_custkey AS phone_number
  FROM customer WHERE c_mktsegment = '{MEMBER_SEGMENT}'),
truck_reviews AS (
  SELECT doc_id AS order_id, lang AS language, source, text AS review, doc_id AS review_id
  FROM documents),
orders_v AS (
  SELECT h.order_id, h.truck_id, h.order_ts, CAST(h.order_ts AS DATE) AS date, d.order_detail_id,
         d.line_number, m.truck_brand_name, m.menu_type, t.primary_city, t.region, t.country,
         t.franchise_flag, t.franchise_id, f.first_name AS franchisee_first_name,
         f.last_name AS franchisee_last_name, p.location_id, c.customer_id, c.first_name,
         c.last_name, c.e_mail, c.phone_number, c.children_count, c.gender, c.marital_status,
         d.menu_item_id, m.menu_item_name, d.quantity, d.unit_price, d.price, h.order_amount,
         h.order_tax_amount, h.order_discount_amount, h.order_total
  FROM order_detail d, order_header h, truck t, menu m, franchise f, location p
  LEFT JOIN customer_loyalty c ON c.customer_id = h.customer_id
  WHERE d.order_id = h.order_id AND h.truck_id = t.truck_id AND d.menu_item_id = m.menu_item_id
    AND t.franchise_id = f.franchise_id AND h.location_id = p.location_id)
"""


def with_roles(sql: str) -> str:
    """Prefix an oracle query with the role tables."""
    return f"WITH {ROLE_SQL.strip()}{sql if sql.lstrip().startswith(',') else ' ' + sql}"

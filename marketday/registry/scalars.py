"""Registered queries: scalar functions, guarded arithmetic, object columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketday.functions import scalar, text
from marketday.operators import objects
from marketday.operators.order_stats import group_order_stats
from marketday.registry.base import Registry, roles, shown, shown_sql, source, with_roles
from marketday.session import scratch_path
from marketday.sources.loads import with_variant
from marketday.sources.sinks import replace_table

R = Registry()


@R.add("sc_date_parts", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, year(o_orderdate) AS y, month(o_orderdate) AS m,
       CAST(CAST(o_orderdate AS DATE) + 7 AS VARCHAR) AS week_later,
       CAST(CAST(o_orderdate AS DATE) - 60 AS VARCHAR) AS frame_start
FROM orders""")
def sc_date_parts(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return source(spark, sf_dir, "orders").select(
        "o_orderkey", day.alias("day"), F.year(day).alias("y"), F.month(day).alias("m"),
        F.date_add(day, 7).alias("week_later"), F.date_sub(day, 60).alias("frame_start"),
    )


@R.add("sc_conditional", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 250000 THEN 'HIGH' ELSE 'LOW' END AS size,
       CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' END AS state,
       coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status
FROM orders""")
def sc_conditional(spark, sf_dir):
    status = F.col("o_orderstatus")
    return source(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_totalprice") >= 250000, "HIGH").otherwise("LOW").alias("size"),
        F.when(status == "F", "done").when(status == "O", "open").alias("state"),
        F.coalesce(F.nullif(status, F.lit("P")), F.lit("pending")).alias("status"),
    )


@R.add("sc_math", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, abs(l_extendedprice - 50000) AS away, greatest(l_quantity, l_linenumber * 10.0::DOUBLE) AS top,
       l_orderkey % 7 AS rest, -l_quantity AS minus, l_extendedprice * (1 - l_discount) AS net,
       l_extendedprice / l_quantity AS unit
FROM lineitem""")
def sc_math(spark, sf_dir):
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return source(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.abs(price - 50000).alias("away"),
        F.greatest(quantity, F.col("l_linenumber") * 10.0).alias("top"),
        (F.col("l_orderkey") % 7).alias("rest"), (-quantity).alias("minus"),
        (price * (1 - F.col("l_discount"))).alias("net"), (price / quantity).alias("unit"),
    )


@R.add("sc_string", f"""
SELECT doc_id, 'built for last ' || doc_id || ' days from ' || source AS message,
       substring(text, 1, {text.SNIPPET_CHARS}) AS snippet,
       md5(substring(text, 1, {text.STATEMENT_CHARS})) AS statement_md5,
       md5(regexp_replace(trim('```sql' || chr(10) || text || chr(10) || '```', ' ' || chr(9) || chr(13) || chr(10)),
                          '{text.CODE_FENCE}', '', 'g')) AS unfenced_md5
FROM documents WHERE length(trim(text)) > 0""")
def sc_string(spark, sf_dir):
    body = F.col("text")
    return source(spark, sf_dir, "documents").filter(F.length(F.trim(body)) > 0).select(
        "doc_id",
        F.concat(F.lit("built for last "), F.col("doc_id"), F.lit(" days from "), F.col("source")).alias("message"),
        text.truncated(body, text.SNIPPET_CHARS).alias("snippet"),
        F.md5(text.truncated(body, text.STATEMENT_CHARS)).alias("statement_md5"),
        F.md5(text.without_fences(F.concat(F.lit("```sql\n"), body, F.lit("\n```")))).alias("unfenced_md5"),
    )


@R.add("json_path_extract", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k_text
FROM events""")
def json_path_extract(spark, sf_dir):
    """A path into a JSON column, as a number and as text."""
    events = with_variant(source(spark, sf_dir, "events"), "props")
    return events.select(
        "event_id", F.variant_get("props", "$.k", "bigint").alias("k"), F.variant_get("props", "$.k", "string").alias("k_text")
    )


# ---- guarded arithmetic, called as SQL functions ------------------------------------------------


@R.add("udf_safe_divide", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio
FROM lineitem""")
def udf_safe_divide(spark, sf_dir):
    scalar.register(spark)
    lines = source(spark, sf_dir, "lineitem")
    return lines.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "safe_divide(l_tax, l_discount) AS ratio")


@R.add("udf_zscore", f"""
WITH s AS (SELECT l_partkey, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
       {shown_sql("CASE WHEN sd IS NULL OR sd = 0 THEN NULL ELSE (l_extendedprice - m) / sd END")} AS z
FROM lineitem JOIN s USING (l_partkey)""")
def udf_zscore(spark, sf_dir):
    scalar.register(spark)
    lines = source(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    stats = lines.groupBy("l_partkey").agg(
        F.avg("l_extendedprice").alias("m"), F.stddev_samp("l_extendedprice").alias("sd")
    )
    return lines.join(stats, "l_partkey").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "zscore(l_extendedprice, m, sd) AS z"
    ).withColumn("z", shown("z"))


@R.add("udf_robust_zscore", f"""
WITH s AS (SELECT l_returnflag, median(l_extendedprice) AS m, mad(l_extendedprice) AS d FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, {shown_sql("(l_extendedprice - m) / nullif(1.4826 * d, 0)")} AS rz
FROM lineitem JOIN s USING (l_returnflag)""")
def udf_robust_zscore(spark, sf_dir):
    scalar.register(spark)
    lines = source(spark, sf_dir, "lineitem")
    stats = group_order_stats(lines, ["l_returnflag"], "l_extendedprice").select("l_returnflag", "median", "median_abs_dev")
    return lines.join(stats, "l_returnflag").selectExpr(
        "l_orderkey", "l_linenumber", "l_returnflag", "robust_zscore(l_extendedprice, median, median_abs_dev) AS rz"
    ).withColumn("rz", shown("rz"))


@R.add("udf_coalesce_zero", """
SELECT o_orderkey, coalesce(c_acctbal, 0) AS balance
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey""")
def udf_coalesce_zero(spark, sf_dir):
    scalar.register(spark)
    members = source(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    orders = source(spark, sf_dir, "orders").join(members, F.col("o_custkey") == F.col("c_custkey"), "left")
    return orders.selectExpr("o_orderkey", "coalesce_zero(c_acctbal) AS balance")


# ---- object columns -------------------------------------------------------------------------------


def _machines(spark, sf_dir):
    """Parts as trucks: size, brand and type stand for year, make and model."""
    return source(spark, sf_dir, "part").selectExpr(
        "p_partkey AS truck_id", "p_name AS primary_city", "p_size AS year", "nullif(p_brand, 'Brand#3') AS make",
        "p_type AS model",
    )


def _object_sql(make: str) -> str:
    return (
        "'{\"year\":' || year" + f" || coalesce(',\"make\":\"' || {make} || '\"', '')" + " || ',\"model\":\"' || model || '\"}'"
    )


_MACHINES = """WITH machines AS (
  SELECT p_partkey AS truck_id, p_name AS primary_city, p_size AS year, nullif(p_brand, 'Brand#3') AS make, p_type AS model
  FROM part)"""
_REPAIRED = "CASE WHEN make = 'Brand#1' AND truck_id % 2 = 0 THEN 'Brand#2' ELSE make END"


@R.add("obj_build", f"{_MACHINES} SELECT truck_id, {_object_sql('make')} AS truck_build FROM machines")
def obj_build(spark, sf_dir):
    """An object built from three columns; a NULL field is left out of its text."""
    built = objects.build_object(_machines(spark, sf_dir), "truck_build", ["year", "make", "model"])
    return built.select("truck_id", objects.object_text("truck_build").alias("truck_build"))


@R.add("obj_conditional_update", f"{_MACHINES} SELECT truck_id, {_object_sql(_REPAIRED)} AS truck_build FROM machines")
def obj_conditional_update(spark, sf_dir):
    """One field replaced for even ids that carry the wrong value."""
    built = objects.build_object(_machines(spark, sf_dir), "truck_build", ["year", "make", "model"])
    wrong = (F.col("truck_build.make") == "Brand#1") & (F.col("truck_id") % 2 == 0)
    fixed = objects.set_field_where(built, "truck_build", "make", "Brand#2", wrong)
    return fixed.select("truck_id", objects.object_text("truck_build").alias("truck_build"))


@R.add("ctas_star_exclude", f"{_MACHINES} SELECT truck_id, primary_city, {_object_sql(_REPAIRED)} AS truck_build FROM machines")
def ctas_star_exclude(spark, sf_dir):
    """Everything but the three source columns, stored as a new table and read back."""
    path = scratch_path(spark, "truck-details")
    replace_table(objects.truck_details(_machines(spark, sf_dir), "Brand#1", "Brand#2"), path)
    return spark.read.parquet(path).withColumn("truck_build", objects.object_text("truck_build"))


@R.add("row_as_object", with_roles("""
SELECT order_id, '{"order_id":' || order_id || ',"truck_id":' || truck_id || ',"customer_id":' || customer_id || '}' AS row_json
FROM order_header"""))
def row_as_object(spark, sf_dir):
    """A whole row as one object."""
    header = roles(spark, sf_dir)["order_header"].select("order_id", "truck_id", "customer_id")
    return header.select("order_id", F.to_json(F.struct("*")).alias("row_json"))

"""Registered queries: loads and exports."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from marketday.plans import glossary, inventory
from marketday.registry.base import Registry, roles, source, with_roles
from marketday.registry.governance import EDGES_SQL, R as GOVERNANCE, documents, edges
from marketday.session import scratch_path
from marketday.sources.loads import load_csv, load_files, load_relations, with_variant
from marketday.sources.schemas import RAW
from marketday.sources.sinks import append_rows, export_csv
from marketday.streaming.increment import load_new_csv

R = Registry()

FILE_ROWS = 100  # documents in a text file that is read whole


def _as_csv(df, path: str):
    """What an upstream system would leave in the load folder: CSV without a header."""
    df.write.mode("append").options(header="false", escape='"', emptyValue="").csv(path)


@R.add("src_csv_typed", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderpriority AS order_channel,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_ts, o_totalprice AS order_total,
       CAST(o_orderkey % (SELECT count(*) FROM nation) AS DOUBLE) AS location_id
FROM orders""")
def src_csv_typed(spark, sf_dir):
    """Order headers loaded from CSV files into their declared types."""
    path = scratch_path(spark, "load-order-header")
    _as_csv(roles(spark, sf_dir)["order_header"], path)
    return load_csv(spark, path, RAW["order_header"]).select(
        "order_id", "customer_id", "order_channel", "order_ts", "order_total", "location_id"
    )


@R.add("src_csv_incremental", """
SELECT doc_id AS review_id, doc_id AS order_id, lang AS language, source, md5(text) AS review_md5 FROM documents""")
def src_csv_incremental(spark, sf_dir):
    """Reviews loaded in three runs: some files, no new file, the other files."""
    folder, table, state = (scratch_path(spark, f"reviews-{part}") for part in ("in", "table", "state"))
    reviews = roles(spark, sf_dir)["truck_reviews"]
    options = {"multiLine": "true"}  # reviews hold line breaks
    english = F.col("language") == "en"
    _as_csv(reviews.filter(english), folder)
    load_new_csv(spark, folder, RAW["truck_reviews"], table, state, **options)
    load_new_csv(spark, folder, RAW["truck_reviews"], table, state, **options)
    _as_csv(reviews.filter(~english), folder)
    load_new_csv(spark, folder, RAW["truck_reviews"], table, state, **options)
    return spark.read.parquet(table).select(
        "review_id", "order_id", "language", "source", F.md5("review").alias("review_md5")
    )


@R.add("src_json_column", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.none') IS NULL AS absent FROM events""")
def src_json_column(spark, sf_dir):
    """JSON text loaded from a CSV column, then parsed."""
    path = scratch_path(spark, "load-events")
    _as_csv(source(spark, sf_dir, "events").select("event_id", "props"), path)
    loaded = with_variant(load_csv(spark, path, "event_id bigint, props string"), "props")
    return loaded.select(
        "event_id", F.variant_get("props", "$.k", "bigint").alias("k"),
        F.try_variant_get("props", "$.none", "variant").isNull().alias("absent"),
    )


@R.add("src_edge_csv", f"WITH {EDGES_SQL} SELECT src, dst, op FROM edges")
def src_edge_csv(spark, sf_dir):
    """Relations from a CSV file whose header names the columns."""
    path = scratch_path(spark, "relations")
    export_csv(edges(spark, sf_dir), path)
    return load_relations(spark, path)


def _shown(kind: str, column: str) -> str:
    """A role column as DuckDB prints what :func:`plain` makes of its declared type."""
    if kind.startswith("timestamp"):
        return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({column} AS {'DOUBLE' if kind.startswith(('decimal', 'double')) else 'BIGINT' if kind in ('bigint', 'int') else 'VARCHAR'})"


#: the columns that the test tables fill, and whether the load must keep quoted text
FILLED = {
    "country": ["country_id", "country"],
    "franchise": ["franchise_id", "first_name", "last_name"],
    "location": ["location_id"],
    "menu": ["menu_type_id", "menu_type", "truck_brand_name", "menu_item_id", "menu_item_name"],
    "truck": ["truck_id", "menu_type_id", "primary_city", "region", "country", "franchise_flag", "franchise_id"],
    "order_detail": ["order_detail_id", "order_id", "menu_item_id", "line_number", "quantity", "unit_price", "price"],
    "customer_loyalty": ["customer_id", "first_name", "last_name", "city", "country", "gender", "marital_status", "children_count", "e_mail", "phone_number"],
    "truck_reviews": ["order_id", "language", "source", "review", "review_id"],
}
ROLE_TABLE = {"country": "(SELECT r_regionkey AS country_id, r_name AS country FROM region)"}


def _load_query(role: str, columns: list[str]) -> None:
    kinds = dict(re.findall(r"(\w+) (\w+)", RAW[role]))  # read as text: no session is needed to list the queries
    sql = ", ".join(f"{_shown(kinds[c], c)} AS {c}" for c in columns)

    def load(spark, sf_dir):
        path = scratch_path(spark, f"load-{role}")
        _as_csv(roles(spark, sf_dir)[role], path)
        return load_csv(spark, path, RAW[role], multiLine="true").select(*columns)

    load.__doc__ = f"The {role} table loaded from CSV files into its declared types."
    R.add(f"src_csv_{role}", with_roles(f"SELECT {sql} FROM {ROLE_TABLE.get(role, role)}"))(load)


for _role, _columns in FILLED.items():
    _load_query(_role, _columns)


@R.add("src_csv_types", """
SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS amount, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts, 'said "' || o_orderpriority || '", then' AS quoted,
       o_custkey AS k FROM orders""")
def src_csv_types(spark, sf_dir):
    """Decimals, dates, times, quoted text and JSON text in one load."""
    path, c = scratch_path(spark, "load-types"), F.col
    rows = source(spark, sf_dir, "orders").select(
        "o_orderkey", c("o_totalprice").cast("decimal(18,4)"), F.to_date("o_orderdate"), "o_orderdate",
        F.concat(F.lit('said "'), "o_orderpriority", F.lit('", then')), F.to_json(F.struct(c("o_custkey").alias("k"), F.lit("a,b").alias("v"))),
    )
    _as_csv(rows, path)
    loaded = load_csv(spark, path, "id bigint, amount decimal(18,4), day date, ts timestamp_ntz, quoted string, obj string")
    return with_variant(loaded, "obj").select("id", "amount", "day", "ts", "quoted", F.variant_get("obj", "$.k", "bigint").alias("k"))


@R.add("src_whole_files", """
WITH files AS (SELECT doc_id % 8 AS part, string_agg(text, chr(10) ORDER BY doc_id) AS content FROM documents GROUP BY ALL)
SELECT 'SQL' AS language, CAST(sum(length(content) + 1) AS BIGINT) AS chars, count(*) AS files FROM files""")
def src_whole_files(spark, sf_dir):
    """Documents in eight folders of text files of at most FILE_ROWS documents, read whole and measured as code; a folder is one code file."""
    path = scratch_path(spark, "whole-files")
    docs = source(spark, sf_dir, "documents").select((F.col("doc_id") % 8).alias("part"), "text")
    docs.write.partitionBy("part").options(lineSep="\n", maxRecordsPerFile=FILE_ROWS).text(path)  # the folder names the suffix
    files = load_files(spark, path).select(F.concat_ws("/", "folder", F.regexp_replace("name", "[.]txt$", ".sql")).alias("name"), "content")
    found = inventory.corpus_inventory(files)
    return found.groupBy("language").agg(F.sum("chars").alias("chars"), F.countDistinct(F.substring_index("name", "/", 1)).alias("files"))


@R.add("sink_csv_roundtrip", GOVERNANCE.sql["glossary_columns"].replace("SELECT p_partkey AS doc_id, 'part' AS \"table\", p_name AS \"column\", p_brand AS definition", "SELECT 'part' AS \"Table\", p_name AS \"Column\", p_brand AS \"Definition\"").replace("AS synonyms", 'AS "Synonyms"'))
def sink_csv_roundtrip(spark, sf_dir):
    """The column glossary exported with its headings and read back."""
    path = scratch_path(spark, "glossary")
    export_csv(glossary.for_export(glossary.glossary_columns(documents(spark, sf_dir))), path)
    return load_relations(spark, path)


@R.add("sink_append_default", """
SELECT o_orderstatus, count(*) AS n, true AS stamped FROM orders GROUP BY ALL
UNION ALL SELECT o_orderpriority, count(*), true FROM orders GROUP BY ALL""")
def sink_append_default(spark, sf_dir):
    """Two row sets appended to a log whose time column fills itself."""
    path = scratch_path(spark, "log")
    orders = source(spark, sf_dir, "orders")
    for column in ("o_orderstatus", "o_orderpriority"):
        counted = orders.groupBy(F.col(column).alias("o_orderstatus")).agg(F.count(F.lit(1)).alias("n"))
        append_rows(counted.withColumn("run_ts", F.current_timestamp().cast("timestamp_ntz")), path)
    return spark.read.parquet(path).select("o_orderstatus", "n", F.col("run_ts").isNotNull().alias("stamped"))

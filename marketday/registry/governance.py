"""Registered queries: lineage, glossary, column dictionary and corpus jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketday.operators.graph import khop, khop_many
from marketday.plans import glossary, inventory, lineage
from marketday.registry.base import Registry, source, stored
from marketday.session import stage
from marketday.sources.standin import TEST_SCHEMAS, TEST_TABLES

R = Registry()


# ---- lineage over the foreign keys: region -> nation -> supplier -> part -> brand -----------------


def edges(spark, sf_dir):
    def link(table, kind, key, to_kind, to_key, op):
        return source(spark, sf_dir, table).select(
            F.concat(F.lit(f"{kind}:"), F.col(key)).alias("src"),
            F.concat(F.lit(f"{to_kind}:"), F.col(to_key)).alias("dst"),
            F.lit(op).alias("op"),
        )

    return (
        link("nation", "region", "n_regionkey", "nation", "n_nationkey", "JOIN")
        .unionByName(link("supplier", "nation", "s_nationkey", "supplier", "s_suppkey", "JOIN"))
        .unionByName(link("lineitem", "supplier", "l_suppkey", "part", "l_partkey", "SALE").distinct())
        .unionByName(link("part", "part", "p_partkey", "brand", "p_brand", "GROUP BY"))
    )


EDGES_SQL = """
edges AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'JOIN' AS op FROM nation
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'JOIN' FROM supplier
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'SALE' FROM lineitem
  UNION ALL SELECT 'part:' || p_partkey, 'brand:' || p_brand, 'GROUP BY' FROM part)"""


def _khop_sql(target: str, hops: int) -> str:
    return f"""WITH RECURSIVE {EDGES_SQL},
down AS (SELECT '{target}' AS node, 0 AS hop
         UNION SELECT dst, hop + 1 FROM down JOIN edges ON src = node WHERE hop < {hops}),
up AS (SELECT '{target}' AS node, 0 AS hop
       UNION SELECT src, hop + 1 FROM up JOIN edges ON dst = node WHERE hop < {hops}),
reached AS (
  SELECT node, 'down' AS direction, min(hop) AS hop FROM down WHERE node <> '{target}' GROUP BY node
  UNION ALL SELECT node, 'up', min(hop) FROM up WHERE node <> '{target}' GROUP BY node
  UNION ALL SELECT '{target}', 'target', 0)"""


def _picked_sql(target: str, hops: int) -> str:
    return _khop_sql(target, hops) + f""",
nodes AS (SELECT node, min(hop) AS hop FROM reached GROUP BY node),
inner_edges AS (SELECT * FROM edges WHERE src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes)),
degrees AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM inner_edges UNION ALL SELECT dst FROM inner_edges) GROUP BY node),
picked AS (SELECT node, hop, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degrees USING (node)
           ORDER BY hop, degree DESC, node LIMIT {lineage.NODE_CAP})"""


@R.add("lineage_khop", _khop_sql("supplier:5", 2) + " SELECT node, direction, CAST(hop AS BIGINT) AS hop FROM reached")
def lineage_khop(spark, sf_dir):
    """Nodes within two hops up- and downstream of a supplier."""
    return khop(stored(edges(spark, sf_dir)), "supplier:5", lineage.DEFAULT_HOPS)


@R.add("lineage_khop_deep", _khop_sql("nation:3", 5) + " SELECT node, direction, CAST(hop AS BIGINT) AS hop FROM reached")
def lineage_khop_deep(spark, sf_dir):
    """Nodes within five hops of a nation."""
    return khop(stored(edges(spark, sf_dir)), "nation:3", 5)


_MANY = [f"nation:{n}" for n in range(24)] + [f"supplier:{n}" for n in range(1, 40)] + ["region:1"]


@R.add("lineage_khop_many", f"""WITH RECURSIVE {EDGES_SQL},
targets AS (SELECT unnest({_MANY!r}) AS target),
down AS (SELECT target, target AS node, 0 AS hop FROM targets
         UNION SELECT target, dst, hop + 1 FROM down JOIN edges ON src = node WHERE hop < 3),
up AS (SELECT target, target AS node, 0 AS hop FROM targets
       UNION SELECT target, src, hop + 1 FROM up JOIN edges ON dst = node WHERE hop < 3)
SELECT target, node, 'down' AS direction, CAST(min(hop) AS BIGINT) AS hop FROM down WHERE node <> target GROUP BY ALL
UNION ALL SELECT target, node, 'up', CAST(min(hop) AS BIGINT) FROM up WHERE node <> target GROUP BY ALL
UNION ALL SELECT target, target, 'target', 0 FROM targets""")
def lineage_khop_many(spark, sf_dir):
    """Nodes within three hops of 64 nations, suppliers and a region, in one search."""
    return khop_many(stored(edges(spark, sf_dir)), _MANY, 3)


def _kind():
    kinds = {"region": "source", "nation": "stage", "supplier": "transform", "part": "table", "brand": "view"}
    kind = F.lit(None).cast("string")
    for prefix, name in kinds.items():
        kind = F.when(F.col("node").startswith(prefix + ":"), name).otherwise(kind)
    return kind


def _subgraph(spark, sf_dir):
    return lineage.subgraph(stored(edges(spark, sf_dir)), _kind(), "supplier:5")




def _case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_VIVID = lineage.THEMES["vibrant"]


@R.add("lineage_subgraph", _picked_sql("supplier:5", 2) + f"""
, kinds AS (SELECT *, node = 'supplier:5' AS is_target,
              CASE split_part(node, ':', 1) WHEN 'region' THEN 'source' WHEN 'nation' THEN 'stage'
                WHEN 'supplier' THEN 'transform' WHEN 'part' THEN 'table' WHEN 'brand' THEN 'view' END AS kind FROM picked)
SELECT node, CAST(hop AS BIGINT) AS hop, degree, kind, is_target, {_case("kind", lineage.SHAPES)} AS shape,
       CASE WHEN is_target THEN '{_VIVID["target"]}' ELSE {_case("kind", {k: _VIVID[k] for k in lineage.SHAPES})} END AS fillcolor,
       CASE WHEN is_target THEN '{_VIVID["target_border"]}' ELSE '{_VIVID["border"]}' END AS color,
       CAST(CASE WHEN is_target THEN 3 ELSE 1 END AS BIGINT) AS penwidth
FROM kinds""")
def lineage_subgraph(spark, sf_dir):
    """The diagram's nodes: at most 200, nearest and best connected first, with their style."""
    return _subgraph(spark, sf_dir)[0]


@R.add("lineage_subgraph_edges", _picked_sql("supplier:5", 2) + f"""
SELECT src, dst, op, '{_VIVID["edge"]}' AS color FROM edges
WHERE src IN (SELECT node FROM picked) AND dst IN (SELECT node FROM picked)""")
def lineage_subgraph_edges(spark, sf_dir):
    """The diagram's edges: both ends among its nodes."""
    return _subgraph(spark, sf_dir)[1]


# ---- glossary documents, one per part; their form depends on the part's type ----------------------


def documents(spark, sf_dir):
    column = """named_struct('table', 'part', 'column', p_name, 'definition', p_brand,
        'synonyms', array(p_type, cast(p_size AS string), p_type, p_name, p_brand, concat('size ', p_size),
                          concat('key ', p_partkey)))"""
    plain_column = "named_struct('table', 'part', 'column', p_name, 'definition', '', 'description', p_brand, 'synonyms', p_type)"
    term = "named_struct('term', {0}, 'name', {1}, 'definition', {2}, 'description', {3})"  # NULL fields are not written
    none = "cast(NULL AS string)"
    terms = f"array({term.format('p_name', none, 'p_brand', none)}, {term.format(none, 'p_type', none, 'p_name')})"
    term_json = f"to_json(named_struct('terms', {terms}))"
    body = f"""CASE p_type
        WHEN 'PROMO' THEN to_json(named_struct('business_glossary', named_struct('columns', array({column}))))
        WHEN 'SMALL' THEN to_json(named_struct('text', p_name, 'columns', array({column})))
        WHEN 'LARGE' THEN concat('{{', p_name)
        WHEN 'MEDIUM' THEN concat('{{"columns":[1,', to_json({plain_column}), '],', substring({term_json}, 2))
        WHEN 'ECONOMY' THEN to_json(named_struct('columns', {column}))
        ELSE to_json(named_struct('columns', array({column}), 'terms', {terms}))
    END"""
    return source(spark, sf_dir, "part").selectExpr("p_partkey AS doc_id", f"{body} AS body")


_SYNONYMS = "p_type || ', ' || p_size || ', ' || {again}p_name || ', ' || p_brand || ', size ' || p_size{key}"


def _columns_sql(synonyms: str) -> str:
    return f"""
SELECT p_partkey AS doc_id, 'part' AS "table", p_name AS "column", p_brand AS definition,
       CASE WHEN p_type = 'MEDIUM' THEN p_type ELSE {synonyms} END AS synonyms
FROM part WHERE p_type IN ('PROMO', 'MEDIUM', 'STANDARD')"""


@R.add("glossary_columns", _columns_sql(_SYNONYMS.format(again="p_type || ', ' || ", key=" || ', key ' || p_partkey")))
def glossary_columns(spark, sf_dir):
    """Described columns of all documents."""
    return glossary.glossary_columns(documents(spark, sf_dir))


@R.add("glossary_synonyms_capped", _columns_sql(_SYNONYMS.format(again="", key="")))
def glossary_synonyms_capped(spark, sf_dir):
    """The same with at most five different synonyms each."""
    return glossary.glossary_columns(documents(spark, sf_dir), cap_synonyms=True)


@R.add("glossary_terms", """
SELECT p_partkey AS doc_id, p_name AS term, p_brand AS definition FROM part WHERE p_type IN ('MEDIUM', 'STANDARD')
UNION ALL SELECT p_partkey, p_type, p_name FROM part WHERE p_type IN ('MEDIUM', 'STANDARD')""")
def glossary_terms(spark, sf_dir):
    """Business terms of all documents."""
    return glossary.glossary_terms(documents(spark, sf_dir))


@R.add("glossary_texts", """
SELECT p_partkey AS doc_id, CASE p_type WHEN 'LARGE' THEN '{' || p_name ELSE p_name END AS text
FROM part WHERE p_type IN ('SMALL', 'LARGE')""")
def glossary_texts(spark, sf_dir):
    """Documents that are plain text: not JSON, or carrying a text of their own."""
    return glossary.glossary_texts(documents(spark, sf_dir))


# ---- dictionaries and inventories -------------------------------------------------------------------

def _dictionary_sql() -> str:
    parts = []
    for table in TEST_TABLES:
        for i, column in enumerate(TEST_SCHEMAS[table].split(", ")):
            name, kind = column.split(" ")
            parts.append(
                f"SELECT '{table}' AS table_name, CAST({i + 1} AS BIGINT) AS position, '{name}' AS column_name, '{kind}' AS data_type, "
                f"true AS nullable, count(*) AS row_count, count(*) - count({name}) AS null_count, "
                f"count(DISTINCT {name}) AS distinct_count FROM {table}"
            )
    return " UNION ALL ".join(parts)


@R.add("column_dictionary", _dictionary_sql())
def column_dictionary(spark, sf_dir):
    """Type, nullability, rows, NULLs and distinct values of every column of every table."""
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TEST_TABLES}  # types as the files say
    return inventory.column_dictionaries(tables)


@R.add("column_dictionary_merged", f"""
SELECT table_name, position, column_name, row_count, null_count, true AS within_bound FROM ({_dictionary_sql()})""")
def column_dictionary_merged(spark, sf_dir):
    """Every table as two loads with stored sketches; merged rows and NULLs, and whether the estimate keeps its bound."""
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TEST_TABLES}
    half = {name: F.pmod(F.xxhash64(F.col(df.columns[0])), F.lit(2)) for name, df in tables.items()}
    loads = [
        inventory.column_sketches(name, df.filter(half[name] == k), f"load {k}") for name, df in tables.items() for k in (0, 1)
    ]
    merged = inventory.merged_dictionary(stage(reduce(DataFrame.unionByName, loads), "sketches"))
    exact = inventory.column_dictionaries(tables).select("table_name", "position", "distinct_count")
    off = F.abs(F.col("distinct_estimate") - F.col("distinct_count"))
    return merged.join(exact, ["table_name", "position"]).select(
        "table_name", "position", "column_name", "row_count", "null_count",
        (off <= F.ceil(inventory.ERROR * F.col("distinct_count"))).alias("within_bound"),
    )


@R.add("corpus_inventory", """
WITH files AS (SELECT source || '_' || doc_id || CASE lang WHEN 'en' THEN '.sql' WHEN 'de' THEN '.PY' WHEN 'fr' THEN '.Java'
                 WHEN 'es' THEN '.scala' ELSE '.txt' END AS name, text AS content, lang FROM documents),
labelled AS (SELECT *, CASE lang WHEN 'en' THEN 'SQL' WHEN 'de' THEN 'Python' WHEN 'fr' THEN 'Java'
                 WHEN 'es' THEN 'Scala' ELSE '' END AS language FROM files)
SELECT name, language, length(content) AS chars, 'FILE: ' || name || ' (language: ' || language || ')' AS header FROM labelled""")
def corpus_inventory(spark, sf_dir):
    """Documents as code files: language by suffix, size in characters, header line."""
    suffix = F.lit(".txt")
    for lang, ending in {"en": ".sql", "de": ".PY", "fr": ".Java", "es": ".scala"}.items():
        suffix = F.when(F.col("lang") == lang, ending).otherwise(suffix)
    files = source(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("_"), "doc_id", suffix).alias("name"), F.col("text").alias("content")
    )
    return inventory.corpus_inventory(files)

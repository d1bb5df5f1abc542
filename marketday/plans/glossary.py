"""Flatten stored glossary documents (JSON text) into rows.

Documents are parsed once into a variant; a list is exploded entry by entry, so one odd entry never
spoils the rest of its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketday.functions.text import first_filled

MAX_SYNONYMS = 5  # fixed value

EXPORT_COLUMNS = {"table": "Table", "column": "Column", "definition": "Definition", "synonyms": "Synonyms"}


def parsed(docs: DataFrame, body: str = "body") -> DataFrame:
    """Add ``doc``: the document as a variant when it is a glossary object, NULL when it is text.

    Text is whatever does not parse, is not an object, or carries a ``text`` key.
    """
    doc = F.try_parse_json(body)
    is_glossary = (
        F.schema_of_variant(doc).startswith("OBJECT")
        & F.try_variant_get(doc, "$.text", "variant").isNull()
    )
    return docs.withColumn("doc", F.when(is_glossary, doc))


def _known(variant: Column) -> Column:
    """A variant that is there and not JSON null."""
    return F.when(~F.is_variant_null(variant), variant)


def _entries(docs: DataFrame, listed: Column) -> DataFrame:
    """One row per object in a list; anything but a list has no rows, other entries are skipped."""
    spark = docs.sparkSession
    with_list = docs.withColumn("listed", F.when(F.schema_of_variant(listed).startswith("ARRAY"), listed))
    exploded = with_list.lateralJoin(spark.tvf.variant_explode(F.col("listed").outer()))
    return exploded.filter(F.schema_of_variant("value").startswith("OBJECT"))


def _text(path: str) -> Column:
    return F.try_variant_get("value", f"$.{path}", "string")


def _synonym_list() -> Column:
    return F.try_variant_get("value", "$.synonyms", "array<string>")


def glossary_columns(docs: DataFrame, body: str = "body", cap_synonyms: bool = False) -> DataFrame:
    """One row per described column: ``table, column, definition, synonyms``.

    The list sits under ``columns``, or under ``business_glossary.columns`` when the first is absent.
    ``cap_synonyms`` keeps at most five different synonyms.
    """
    docs = parsed(docs, body)
    doc = F.col("doc")
    listed = F.coalesce(
        _known(F.try_variant_get(doc, "$.columns", "variant")),
        _known(F.try_variant_get(doc, "$.business_glossary.columns", "variant")),
    )
    names = _synonym_list()
    if cap_synonyms:
        names = F.slice(F.array_distinct(names), 1, MAX_SYNONYMS)
    synonyms = F.coalesce(F.array_join(names, ", ", "None"), _text("synonyms"), F.lit(""))
    kept = [c for c in docs.columns if c not in (body, "doc")]
    return _entries(docs, listed).select(
        *kept,
        first_filled(_text("table")).alias("table"),
        first_filled(_text("column")).alias("column"),
        first_filled(_text("definition"), _text("description")).alias("definition"),
        synonyms.alias("synonyms"),
    )


def glossary_terms(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row per business term: ``term, definition``."""
    docs = parsed(docs, body)
    kept = [c for c in docs.columns if c not in (body, "doc")]
    return _entries(docs, F.try_variant_get(F.col("doc"), "$.terms", "variant")).select(
        *kept,
        first_filled(_text("term"), _text("name")).alias("term"),
        first_filled(_text("definition"), _text("description")).alias("definition"),
    )


def glossary_texts(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row per document that is not a glossary object: its ``text`` field, else the raw document."""
    docs = parsed(docs, body).filter(F.col("doc").isNull())
    kept = [c for c in docs.columns if c not in (body, "doc")]
    stored = F.try_variant_get(F.try_parse_json(body), "$.text", "string")
    return docs.select(*kept, F.coalesce(stored, F.col(body)).alias("text"))


def for_export(columns: DataFrame) -> DataFrame:
    """The columns and headings of the exported file."""
    return columns.select(*[F.col(c).alias(heading) for c, heading in EXPORT_COLUMNS.items()])

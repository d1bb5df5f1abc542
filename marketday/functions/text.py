"""Small text expressions shared by the glossary, corpus and run-log jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statement and snippet lengths, language labels by file suffix, the code-fence pattern.
STATEMENT_CHARS = 2000
SNIPPET_CHARS = 180
LANGUAGE_BY_SUFFIX = {".sql": "SQL", ".py": "Python", ".java": "Java", ".scala": "Scala"}
CODE_FENCE = r"^```[a-zA-Z]*\n|\n```$"


def first_filled(*cols: Column) -> Column:
    """The first value that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def truncated(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


def language_label(name: Column) -> Column:
    """Language of a code file by its suffix, whatever the case; empty when unknown."""
    lowered = F.lower(name)
    label = F.lit("")
    for suffix, language in LANGUAGE_BY_SUFFIX.items():
        label = F.when(lowered.endswith(suffix), language).otherwise(label)
    return label


def without_fences(col: Column) -> Column:
    """Text without a leading and a trailing code-fence line."""
    return F.regexp_replace(F.trim(col, F.lit(" \t\r\n")), CODE_FENCE, "")

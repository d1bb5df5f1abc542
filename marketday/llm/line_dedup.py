"""Line dedup: lines found in many documents are dropped everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketday.llm.common import LOWER, UPPER, row_key

SPACE = " \t\n\x0b\x0c\r"


def _lines(text):
    return F.split(text, "\n", -1)


def _line_key(line):
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The rows of ``docs`` with ``n_lines``, ``n_dropped`` and ``kept`` (the text without its dropped lines).

    A line's key is the line stripped of ASCII white space at both ends, A-Z in lower case.  Keys of at least
    ``min_chars`` code points found in at least ``min_docs`` documents (distinct doc_id; a null doc_id counts as a
    document of its own text) lose all their lines.  A null or empty text is one empty line; a document that
    loses every line keeps the empty text.  Rows that repeat are all kept, with the same result each.

    Only 128-bit hashes of lines are shuffled.  A document's distinct keys are taken within its row, so a line
    repeated inside a document costs one row; counting is by (key, document) first and by key after, so a key
    held by a third of all documents is spread over the cluster.
    """
    full = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    r1, r2 = row_key("doc_id", "_text")
    keyed = full.select(F.coalesce("doc_id", F.xxhash64("_text")).alias("_doc"), r1.alias("_r1"), r2.alias("_r2"), "_text")
    h1, h2 = row_key(F.col("key"))
    lines = (
        keyed.select("_doc", "_r1", "_r2", F.posexplode(_lines(F.col("_text"))).alias("pos", "line"))
        .select("_doc", "_r1", "_r2", "pos", _line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("_doc", "_r1", "_r2", "pos", h1.alias("h1"), h2.alias("h2"))
    )
    per_doc = keyed.select("_doc", F.explode(F.array_distinct(F.transform(_lines(F.col("_text")), _hashed(min_chars)))).alias("k")).where("k IS NOT NULL")
    common = (
        per_doc.select("_doc", "k.h1", "k.h2").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_docs).select("h1", "h2")
    )
    dropped = lines.join(common, ["h1", "h2"]).groupBy("_r1", "_r2").agg(F.collect_set("pos").alias("_drop"))
    k1, k2 = row_key("doc_id", "_text")
    joined = full.withColumns({"_r1": k1, "_r2": k2}).join(dropped, ["_r1", "_r2"], "left")
    parts = _lines(F.col("_text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_drop"))
    kept = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    return joined.withColumns({
        "n_lines": F.size(parts).cast("long"),
        "n_dropped": F.coalesce(F.size("_drop"), F.lit(0)).cast("long"),
        "kept": F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(kept),
    }).drop("_text", "_r1", "_r2", "_drop")


def _hashed(min_chars: int):
    def struct(line):
        h1, h2 = row_key(_line_key(line))
        return F.when(F.length(_line_key(line)) >= min_chars, F.struct(h1.alias("h1"), h2.alias("h2")))

    return struct


def digest(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE common.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.key = common.key GROUP BY doc_id
"""

"""Merkle manifest of a table: levels stored as parent-linked node rows, proofs by a recursive query that climbs them."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketday.llm import sqlparts
from marketday.llm.common import LOWER, UPPER, Scratch, crc_fold

ARITY = 16
DIGEST = 64  # hexadecimal characters of a digest
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
ABOVE = -1  # the tree over the groups' roots
PER_COPY = 4096  # leaves that climb through one copy of a node


def _field(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[_field(c) for c in columns]), 256)


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, scratch: Scratch, name: str) -> DataFrame:
    """``out``: 0, 1, 2 ... in ``order`` within each group, for groups of any size.

    One sort of the whole table by range; a row's number is its place in its sorted part plus the rows of its
    group in the parts before.  Only one count for each part and group is looked at across parts.  Rows that tie may
    be numbered either way, and are spread over parts like others.
    """
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*group, *order, "_tie")
    placed = scratch.put(placed.withColumn("_at", F.monotonically_increasing_id()).drop("_tie"), name)
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).select(
        *group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return placed.join(parts, [*group, "_part"]).withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _runs(children: DataFrame, level: int) -> DataFrame:
    """The parents of one level: every ARITY consecutive children (tree, idx, hash, below, count) make a run."""
    kids = F.array_sort(F.collect_list(F.struct("idx", "hash")))
    runs = children.groupBy("tree", F.expr(f"idx div {ARITY}").alias("idx")).agg(
        kids.alias("kids"), F.sum("below").alias("below"), F.first("count").alias("count")
    )
    return runs.select(
        "tree", F.lit(level).alias("level"), "idx", F.array_join("kids.hash", "").alias("run"), "below",
        F.ceil(F.col("count") / ARITY).alias("count"),
    ).withColumn("hash", F.sha2("run", 256))


def _levels(leaves: DataFrame, most: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """All levels above ``leaves`` (tree, idx, hash, below, count), until no tree has several nodes."""
    out, cur, level = [], leaves, 0
    while most > 1:
        level, most = level + 1, -(-most // ARITY)
        cur = scratch.put(_runs(cur.where("count > 1"), level), f"{name}-{level}")
        out.append(cur)
    return out


class Manifest:
    """``nodes``: (tree, level, idx, run, hash, copies, copy) and the parent (up_tree, up_level, up_idx, place, up_copies).

    ``run`` is the text of a node's children.  The root has no parent.  ``roots`` holds each group's root (``tree``,
    ``source`` key, ``hash``), ``anchors`` the lowest nodes with their leaves.
    """

    def __init__(self, leaves: DataFrame, scratch: Scratch):
        """``leaves``: (source, doc_id, leaf, changed): changed is the digest after tampering, null where none."""
        # the group's key keeps its order: null before the empty text
        keyed = scratch.put(leaves.withColumn("_s", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))).drop("source"), "leaves")
        numbered = ranked(keyed, ["_s"], ["doc_id", "leaf"], "idx", scratch, "sorted")
        sizes = keyed.groupBy("_s").agg(F.count("*").alias("count"))
        trees = scratch.put(ranked(sizes, [], ["_s"], "tree", scratch, "groups"), "trees")
        numbered = scratch.put(numbered.join(trees, "_s").drop("_s"), "numbered")
        most = trees.agg(F.max("count"), F.count("*")).first()
        self.empty, groups = most[0] is None, most[1]
        if self.empty:
            return
        own = numbered.select("tree", "idx", F.col("leaf").alias("hash"), F.lit(1).cast("long").alias("below"), "count")
        levels = _levels(own, most[0], scratch, "level")
        lone = own.where("count = 1").select("tree", F.lit(0).alias("level"), "idx", F.lit("").alias("run"), "below", "count", "hash")
        below = lone
        for level in levels:
            below = below.unionByName(level)
        self.roots = scratch.put(below.where("count = 1"), "roots")
        crowd = self.roots.select(F.lit(ABOVE).cast("long").alias("tree"), F.col("tree").alias("idx"), "hash", "below", F.lit(groups).cast("long").alias("count"))
        above = _levels(crowd, groups, scratch, "above")
        nodes = below
        for level in above:
            nodes = nodes.unionByName(level)
        last = F.col("count") == 1
        inner = F.when(~last, F.col("tree")).when((F.col("tree") != ABOVE) & F.lit(groups > 1), F.lit(ABOVE))
        nodes = nodes.select(
            "tree", "level", "idx", "run", "hash", (last & (F.col("tree") != ABOVE)).alias("top"),
            F.greatest(F.lit(1), F.ceil(F.col("below") / PER_COPY)).alias("copies"),
            inner.cast("long").alias("up_tree"), F.when(last, F.lit(1)).otherwise(F.col("level") + 1).alias("up_level"),
            F.when(last, F.expr(f"tree div {ARITY}")).otherwise(F.expr(f"idx div {ARITY}")).alias("up_idx"),
            (F.when(last, F.col("tree")).otherwise(F.col("idx")) % ARITY).cast("int").alias("place"),
        )
        nodes = scratch.put(nodes, "unlinked")
        up = nodes.select(*[F.col(c).alias(f"up_{c}") for c in ("tree", "level", "idx", "copies")])
        self.nodes = scratch.put(nodes.join(up, ["up_tree", "up_level", "up_idx"], "left"), "nodes")
        self.root = self.nodes.where("up_tree IS NULL").select("hash").first()[0]
        members = F.array_sort(F.collect_list(F.struct("idx", "doc_id", "leaf", "changed")))
        bottom = numbered.withColumns({"level": F.when(F.col("count") > 1, 1).otherwise(0), "idx_up": F.expr(f"idx div {ARITY}")})
        bottom = bottom.groupBy("tree", "level", F.col("idx_up").alias("n")).agg(members.alias("members")).withColumnRenamed("n", "idx")
        self.anchors = bottom.join(self.nodes.drop("copies"), ["tree", "level", "idx"])


@contextmanager
def _any_number_of_rows(spark: SparkSession):
    """Recursive queries end at a million rows unless told otherwise."""
    key = "spark.sql.cteRecursionRowLimit"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, old)


# Leaves of one run share everything above it, so they climb in one row, each with a fold of its own.
CLIMB = f"""
WITH RECURSIVE climb(members, above, subroot, up_tree, up_level, up_idx, up_copies, place, lot) AS (
  SELECT members, '' AS above, subroot, up_tree, up_level, up_idx, up_copies, place, lot FROM {{start}}
  UNION ALL
  SELECT transform(c.members, m -> named_struct('doc_id', m.doc_id, 'leaf', m.leaf, 'near', m.near, 'fold',
             sha2(concat(substr(n.run, 1, {DIGEST} * c.place), m.fold, substr(n.run, {DIGEST} * c.place + {DIGEST + 1})), 256))),
         concat(c.above, substr(n.run, 1, {DIGEST} * c.place), substr(n.run, {DIGEST} * c.place + {DIGEST + 1})),
         coalesce(c.subroot, CASE WHEN n.top THEN n.hash END),
         n.up_tree, n.up_level, n.up_idx, n.up_copies, n.place, c.lot
  FROM climb c JOIN {{nodes}} n
    ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_idx = n.idx AND pmod(c.lot, c.up_copies) = n.copy)
SELECT members, above, subroot FROM climb WHERE up_tree IS NULL
"""


def prove(manifest: Manifest, scratch: Scratch) -> DataFrame:
    """For each leaf: doc_id, leaf, subroot, root, siblings (text, from its run up to the root), folded_root.

    A node that many leaves climb through stands in the table once for every PER_COPY of them, so no row of the upper
    levels is met by more than a few hundred rows of the climb.
    """
    spark = scratch.spark
    run = F.array_join("members.leaf", "")
    folds = F.expr(f"""transform(members, (m, i) -> named_struct('doc_id', m.doc_id, 'leaf', m.leaf,
        'near', concat(substr(own, 1, {DIGEST} * i), substr(own, {DIGEST} * i + {DIGEST + 1})),
        'fold', CASE WHEN level = 0 THEN coalesce(m.changed, m.leaf) ELSE sha2(concat(substr(own, 1, {DIGEST} * i),
            coalesce(m.changed, m.leaf), substr(own, {DIGEST} * i + {DIGEST + 1})), 256) END))""")
    start = manifest.anchors.withColumn("own", run).select(
        folds.alias("members"), F.when(F.col("top"), F.col("hash")).alias("subroot"),
        "up_tree", "up_level", "up_idx", "up_copies", "place", F.xxhash64("tree", "idx").alias("lot"),
    )
    nodes = manifest.nodes.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    with _any_number_of_rows(spark):
        climbed = scratch.put(spark.sql(CLIMB, start=scratch.put(start, "start"), nodes=scratch.put(nodes, "copies")), "climbed")
    return climbed.select("above", "subroot", F.explode("members").alias("m")).select(
        "m.doc_id", "m.leaf", "subroot", F.lit(manifest.root).alias("root"),
        F.concat("m.near", "above").alias("siblings"), F.col("m.fold").alias("folded_root"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` by source, and each row's proof; texts of one fifth of the ids are tampered with.

    A row that repeats is a leaf each time.  Rows of one source and id are ordered by their digests, a null id comes first
    and is never tampered with.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    told = [F.col(c) for c in COLUMNS]
    lower = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in COLUMNS]
    touched = (crc_fold() == 0) & (F.translate("text", UPPER, LOWER) != F.col("text"))
    leaves = docs.select("source", "doc_id", leaf_digest(told).alias("leaf"), F.when(touched, leaf_digest(lower)).alias("changed"))
    manifest = Manifest(leaves, scratch)
    if manifest.empty:
        return docs.select("doc_id", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"))
    return prove(manifest, scratch).select(
        "doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _field_sql(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR END"


def _tree_sql(name: str, start: str, levels: int) -> str:
    """``name``0 to ``name``N (t, i, h, run): a tree of one node stays as it is, its run is empty."""
    parts = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY t) AS c FROM ({start}))"]
    for k in range(levels):
        parts.append(f"""{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY t) AS c FROM (
  SELECT t, i // {ARITY} AS i, CASE WHEN max(c) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
         CASE WHEN max(c) = 1 THEN '' ELSE string_agg(h, '' ORDER BY i) END AS run FROM {name}{k} GROUP BY t, i // {ARITY}))""")
    return ",\n".join(parts)


def _climb_sql(name: str, tree: str, start: str, tree_key: str, place: str, levels: int) -> str:
    parts = [f"{name}0 AS ({start})"]
    for k in range(levels):
        at = f"{DIGEST} * ((f.{place} // {ARITY**k}) % {ARITY})"
        left, right = f"substr(run, 1, {at})", f"substr(run, {at} + {DIGEST + 1})"
        parts.append(f"""{name}{k + 1} AS (
  SELECT f.* EXCLUDE (fold, siblings), CASE WHEN run = '' THEN fold ELSE sha256({left} || fold || {right}) END AS fold,
         siblings || {left} || {right} AS siblings
  FROM {name}{k} f JOIN {tree}{k + 1} n ON n.t = f.{tree_key} AND n.i = f.{place} // {ARITY ** (k + 1)})""")
    return ",\n".join(parts)


def _sql(levels: int = 6) -> str:
    """For up to 16^6 rows of a source and as many sources."""
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    told = " || ".join(_field_sql(c) for c in COLUMNS)
    changed = " || ".join(_field_sql(lower if c == "text" else c) for c in COLUMNS)
    return f"""
WITH {sqlparts.CRC_TABLE},
leaves AS (
  SELECT doc_id, source, sha256({told}) AS leaf,
         sha256(CASE WHEN {sqlparts.crc32('doc_id::VARCHAR')} % 5 = 0 THEN {changed} ELSE {told} END) AS start
  FROM documents, crc_table),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaves),
{_tree_sql('low', "SELECT t, p AS i, leaf AS h FROM placed", levels)},
{_tree_sql('high', f"SELECT 0 AS t, t AS i, h FROM low{levels}", levels)},
{_climb_sql('f', 'low', "SELECT doc_id, leaf, t, p, 0 AS one, start AS fold, '' AS siblings FROM placed", 't', 'p', levels)},
{_climb_sql('g', 'high', f"SELECT * FROM f{levels}", 'one', 't', levels)}
SELECT doc_id, leaf, l.h AS subroot, r.h AS root, sha256(siblings) AS proof_sha256, fold AS folded_root, fold = r.h AS verified
FROM g{levels} g JOIN low{levels} l ON l.t = g.t CROSS JOIN high{levels} r
"""


SQL = _sql()

"""Hop-limited neighbourhoods over an edge table ``(src, dst, op)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketday.session import stage

MAX_HOPS = 5  # fixed value: the most hops a user can ask for


def khop(edges: DataFrame, target: str, max_hops: int = 2) -> DataFrame:
    """Nodes within ``max_hops`` up- and downstream of a target: ``node, direction, hop``.

    ``hop`` is the least number of edges; the target itself appears once, at hop 0.  Each round
    joins the frontier (one row per node, however it was reached) to the edges, makes the ends
    distinct and drops nodes already reached.  Each frontier is written to the shared folder, so a
    round's plan is one join and lost executors cost one round.  Cycles end by themselves.
    """
    if not 1 <= max_hops <= MAX_HOPS:
        raise ValueError(f"max_hops must be between 1 and {MAX_HOPS}")
    spark = edges.sparkSession
    down = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.lit("down").alias("direction"))
    up = edges.select(F.col("dst").alias("node"), F.col("src").alias("next"), F.lit("up").alias("direction"))
    steps = down.unionByName(up)
    itself = spark.range(1).select(F.lit(target).alias("node"), F.lit("target").alias("direction"), F.lit(0).alias("hop"))
    reached = frontier = itself.withColumn("direction", F.explode(F.array(F.lit("down"), F.lit("up"))))
    for hop in range(1, max_hops + 1):
        frontier = stage(
            steps.join(frontier.select("node", "direction"), ["node", "direction"])
            .select(F.col("next").alias("node"), "direction").distinct()
            .join(reached, ["node", "direction"], "left_anti")
            .withColumn("hop", F.lit(hop)),
            "frontier",
        )
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.filter("hop > 0").unionByName(itself)


MAX_TARGETS = 64  # bits of a long


def khop_many(edges: DataFrame, targets: list[str], max_hops: int = 2) -> DataFrame:
    """``khop`` of up to 64 targets in one search: ``target, node, direction, hop``, one row as ``khop`` gives it for each target.

    Targets are the bits of a long.  A frontier row says which targets reach a node for the first time on this hop; rows that
    meet at a node become one by ``bit_or``, combined before the shuffle.  So a hop is one join with the edges
    and a frontier has at most one row per node and direction, whatever the number of targets.  Only the answer itself has a
    row per target.  A target named twice counts once; one that no edge knows has only its own row.
    """
    if not 1 <= max_hops <= MAX_HOPS:
        raise ValueError(f"max_hops must be between 1 and {MAX_HOPS}")
    targets = sorted(set(targets))
    if len(targets) > MAX_TARGETS:
        raise ValueError(f"at most {MAX_TARGETS} targets at once")
    spark = edges.sparkSession
    named = spark.createDataFrame(list(enumerate(targets)), "bit int, node string")
    start = named.selectExpr("node", "explode(array('down', 'up')) AS direction", "shiftleft(1L, bit) AS bits")
    frontier, found = start, []
    known = start  # which targets have reached a node, on any hop so far
    for hop in range(1, max_hops + 1):
        # An edge is walked from its source going down and from its end going up: one scan, one join.
        ends = F.array(
            F.struct(F.col("src").alias("node"), F.lit("down").alias("direction"), F.col("dst").alias("next")),
            F.struct(F.col("dst").alias("node"), F.lit("up").alias("direction"), F.col("src").alias("next")),
        )
        arrived = (
            edges.select(F.inline(ends)).join(frontier, ["node", "direction"])
            .groupBy(F.col("next").alias("node"), "direction").agg(F.bit_or("bits").alias("bits"))
        )
        before = known.withColumnRenamed("bits", "old")
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        frontier = stage(
            arrived.join(before, ["node", "direction"], "left").select("node", "direction", fresh.alias("bits")).filter("bits <> 0"),
            "frontiers",
        )
        if frontier.isEmpty():
            break
        found.append(frontier.withColumn("hop", F.lit(hop)))
        if hop < max_hops:
            known = stage(known.unionByName(frontier).groupBy("node", "direction").agg(F.bit_or("bits").alias("bits")), "known")
    itself = named.select(F.col("node").alias("target"), "node", F.lit("target").alias("direction"), F.lit(0).alias("hop"))
    names = F.array(*[F.when(F.col("bits").bitwiseAND(F.expr(f"shiftleft(1L, {i})")) != 0, t) for i, t in enumerate(targets)])
    for part in found:
        reached = part.select(F.explode(F.array_compact(names)).alias("target"), "node", "direction", "hop")
        itself = itself.unionByName(reached)
    return itself


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    kept = nodes.select("node").distinct()
    return edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(
        kept.withColumnRenamed("node", "dst"), "dst", "left_semi"
    )


def nearest_nodes(edges: DataFrame, reached: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` nodes, nearest first, then best connected, then by name: ``node, hop, degree``."""
    nodes = reached.groupBy("node").agg(F.min("hop").alias("hop"))
    ends = induced_edges(edges, nodes)
    degree = (
        ends.select(F.col("src").alias("node")).unionAll(ends.select(F.col("dst").alias("node")))
        .groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    )
    return (
        nodes.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        .orderBy("hop", F.desc("degree"), "node").limit(cap)
    )

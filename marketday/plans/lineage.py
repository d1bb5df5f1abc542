"""Lineage of a target as node and edge tables, styled for a diagram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketday.operators.graph import induced_edges, khop, nearest_nodes
from marketday.session import stage

# Size limits, colours per theme, and the shape of each kind of node.
DEFAULT_HOPS = 2
NODE_CAP = 200
PREVIEW_ROWS = 200
TARGET_PENWIDTH = 3
THEMES = {
    "monochrome": {
        "background": "white", "edge": "#555555", "border": "#333333", "source": "#DDDDDD",
        "transform": "#BBBBBB", "table": "#EEEEEE", "view": "#CCCCCC", "stage": "#F5F5F5",
        "target_border": "#111111", "target": "#FFFFFF",
    },
    "muted": {
        "background": "white", "edge": "#8E8E8E", "border": "#6D6D6D", "source": "#CFE8FF",
        "transform": "#FFE9C6", "table": "#E6F0FA", "view": "#E8DDF0", "stage": "#F2F4F7",
        "target_border": "#C62828", "target": "#FFEBEE",
    },
    "vibrant": {
        "background": "white", "edge": "#7A7A7A", "border": "#333333", "source": "#A7E3FF",
        "transform": "#FFD59E", "table": "#BBDEFB", "view": "#D1C4E9", "stage": "#ECEFF1",
        "target_border": "#E53935", "target": "#FFCDD2",
    },
}
SHAPES = {"source": "cylinder", "transform": "box3d", "table": "box", "view": "component", "stage": "folder"}
# --- end of fixed values ---


def palette(theme: str | None) -> dict[str, str]:
    """A theme's colours; an unknown theme is the vibrant one."""
    return THEMES.get((theme or "").lower(), THEMES["vibrant"])


def preview(edges: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """The first 200 relations."""
    return (edges.orderBy(*order_by) if order_by else edges).limit(PREVIEW_ROWS)


def _styled(nodes: DataFrame, target: str, theme: str) -> DataFrame:
    colours = palette(theme)
    is_target = F.col("node") == target
    shape = fill = F.lit(None).cast("string")
    for kind, its_shape in SHAPES.items():
        of_kind = F.col("kind") == kind
        shape = F.when(of_kind, its_shape).otherwise(shape)
        fill = F.when(of_kind, colours[kind]).otherwise(fill)
    return nodes.select(
        "node", "hop", "degree", "kind", is_target.alias("is_target"),
        shape.alias("shape"),
        F.when(is_target, colours["target"]).otherwise(fill).alias("fillcolor"),
        F.when(is_target, colours["target_border"]).otherwise(colours["border"]).alias("color"),
        F.when(is_target, TARGET_PENWIDTH).otherwise(1).alias("penwidth"),
    )


def subgraph(
    edges: DataFrame, kinds, target: str, max_hops: int = DEFAULT_HOPS, theme: str = "vibrant", cap: int = NODE_CAP
) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables around a target.

    ``kinds`` maps the ``node`` column to a kind (an expression).  The cap is part of the feature: a
    diagram shows at most that many nodes; :func:`~marketday.operators.graph.khop` gives all.
    """
    picked = stage(nearest_nodes(edges, khop(edges, target, max_hops), cap), "nodes")
    nodes = _styled(picked.withColumn("kind", kinds), target, theme)
    return nodes, induced_edges(edges, picked).withColumn("color", F.lit(palette(theme)["edge"]))

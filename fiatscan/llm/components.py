"""Connected components of an edge table, each named by its smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> node, component; only nodes that an edge names. Edges with a null end name none.

    Each level points every node to its smallest neighbour, follows these to their ends, and goes on with the edges
    between different ends only, at most half as many nodes. So most edges are met once, and a star is done in one level. Levels
    are written to the shared folder. A node with very many neighbours is pre-aggregated before the shuffle and split by
    the joins' skew handling. The driver sees one count a step.
    """
    left = stored(_edges(edges), "edges")
    found = None
    while True:
        ends = _ends(left)
        if found is None:
            found = ends
        else:
            next_end = ends.select(F.col("node").alias("component"), F.col("component").alias("end"))
            found = stored(found.join(next_end, "component", "left").select("node", F.coalesce("end", "component").alias("component")), "labels")
        end_of = lambda side: ends.select(F.col("node").alias(side), F.col("component").alias(f"{side}_end"))
        between = left.join(end_of("a"), "a").join(end_of("b"), "b").select(F.col("a_end").alias("a"), F.col("b_end").alias("b"))
        left = stored(_edges(between), "edges")
        if not left.limit(1).count():
            return found


def _edges(edges: DataFrame) -> DataFrame:
    """Each pair of different nodes once."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _ends(edges: DataFrame) -> DataFrame:
    """node -> component: where the way over smallest neighbours ends, at a node smaller than all of its own. Ways halve with every step."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
    labels = stored(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("low")), "labels")
    while True:
        jump = labels.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        after = stored(labels.join(jump, "low").select("node", F.col("lower").alias("low"), (F.col("lower") != F.col("low")).alias("moved")), "labels")
        moved = after.where("moved").limit(1).count()
        labels = after.select("node", "low")
        if not moved:
            return labels.withColumnRenamed("low", "component")

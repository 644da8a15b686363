"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialised, materialise, materialise_counted


def _nearest(edges: DataFrame) -> DataFrame:
    """u, m, most: each node with the smallest and the largest of its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))


def _large(e: DataFrame, nearest: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    up = e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return up.join(nearest.select("u", "m"), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small(down: DataFrame, least: DataFrame) -> DataFrame:
    """u and its smaller neighbours, which are all that down holds, are linked to the smallest of these."""
    # The smallest neighbour is itself among the rows: it gives (u, m).
    return down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (u, v); a component is named by its smallest node.

    A node without edges is not returned: it is a component of its own.  A
    round has as many edges as the one before, and rounds grow with the
    logarithm of a component's width.  They end when the edges are stars:
    whoever has a smaller neighbour has no other neighbour.  The same
    aggregation tells this and starts the next round.  Every step is written
    to the shared folder, so that minima are combined before they are dealt,
    and adaptive execution splits the join at a hot node.
    """
    now = materialise(edges.select("u", "v").where("u <> v"), "edges")
    while True:
        nearest, found = materialise_counted(_nearest(now), "nearest", broken=F.count_if((F.col("m") < F.col("u")) & (F.col("most") > F.col("m"))))
        if not found["broken"]:
            drop_materialised(now)
            return nearest.select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
        down = materialise(_large(now, nearest), "edges")
        least = materialise(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        after = materialise(_small(down, least), "edges")
        for gone in (now, nearest, down, least):
            drop_materialised(gone)
        now = after


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes (node, component) as they are after links (u, v) between any nodes.

    Links are taken between classes, so that the stars that classes are
    already need no rounds again.
    """
    of = lambda c: classes.select(F.col("node").alias(c), F.col("component").alias(f"{c}_class"))
    between = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(
        F.coalesce("u_class", "u").alias("u"), F.coalesce("v_class", "v").alias("v"), F.col("u_class").isNull().alias("u_new"), F.col("v_class").isNull().alias("v_new"))
    between = materialise(between, "between")
    held = components(between)
    new = between.where("u_new").select(F.col("u").alias("node")).unionByName(between.where("v_new").select(F.col("v").alias("node")))
    moved = classes.join(held.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return materialise(moved.unionByName(held.join(new, "node", "left_semi")), "classes")

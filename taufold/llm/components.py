"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taufold.sources.stage import stage


def _stars(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v) with u > v are stars only: no u has two smaller ends or is one itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    by_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by_node.filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of ``edges``; the root is the smallest node of its component.

    Alternating star contraction: every node hands its larger neighbours to its
    smallest one, then its smaller ones, until only stars are left.  Minima
    combine before the shuffle and joins meet one row per node, so hubs can be
    split.  Each round is a written table.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    current = stage(edges.filter(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct(), "edges")
    while not _stars(current):
        # Larger neighbours go to the smallest of a node's neighbourhood.
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        # Smaller neighbours, and the node, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stage(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small-star")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def merge_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) after further ``edges`` (a, b): components found before are single nodes of the graph that is searched.

    A node of ``edges`` that ``roots`` lacks is a component of its own.
    """
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    named = edges.join(end("a"), "a", "left").join(end("b"), "b", "left")
    between = named.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    merged = stage(connected_components(between), "merged-roots")
    tops = merged.select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return old.unionByName(merged.join(roots.select("node"), "node", "left_anti"))

"""Connected components by repeated contraction of minimum labels in a scattered order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is one node of the component.

    Each round gives a node the least of itself and its neighbours by the hash of their ids, then contracts every
    node into its label. Hashing scatters the ids, so a path of any order shrinks to about half in each round
    and rounds grow with the logarithm of the nodes; a star or a clique of any size takes two. Links are never
    gathered: a round is two grouped minima and joins, each written to the shared folder. No edges: no rows.
    Loops and repeated edges are ignored.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct())
    both = edges.union(edges.select("b", "a"))
    nodes = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = F.least(F.struct(F.xxhash64("a").alias("h"), "a"), F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("a"))))
        label = materialize(both.groupBy("a").agg(least["a"].alias("label")))
        if nodes is None:
            nodes = label.select(F.col("a").alias("node"), F.col("label").alias("root"))
        else:
            nodes = materialize(
                nodes.join(label, nodes["root"] == label["a"], "left").select("node", F.coalesce("label", "root").alias("root"))
            )
        left, right = label.select("a", F.col("label").alias("la")), label.select(F.col("a").alias("b"), F.col("label").alias("lb"))
        edges = materialize(
            edges.join(left, "a").join(right, "b").where("la <> lb")
            .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        )
    if nodes is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes

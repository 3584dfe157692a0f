"""Connected components by contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _edges(df: DataFrame) -> DataFrame:
    return df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (u, v); component is the smallest node reachable.

    Each round points every node at its smallest neighbour, follows the pointers to local minima by
    doubling, and contracts the edges onto those minima. At least half the nodes of each component go
    in a round, so there are logarithmically many. Edges with a null end and loops are ignored; a node
    that has no other edge is not in the result. Minima are aggregated before the shuffle, so the
    many neighbours of one node do not meet in one task.
    """
    left = materialize(_edges(edges), "edges")
    nodes = None
    while not left.isEmpty():
        both = left.select(F.col("u").alias("n"), F.col("v").alias("m")).union(left.select("v", "u"))
        up = materialize(both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("p")), "parents")
        while True:
            over = up.select(F.col("n").alias("p"), F.col("p").alias("q"))
            up = materialize(up.join(over, "p").select("n", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "parents")
            moved = not up.where("moved").isEmpty()
            up = up.select("n", "p")
            if not moved:
                break
        if nodes is None:
            nodes = up.select(F.col("n").alias("node"), F.col("p").alias("component"))
        else:
            step = up.select(F.col("n").alias("component"), F.col("p").alias("root"))
            nodes = materialize(nodes.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "nodes")
        to = left.join(up.select(F.col("n").alias("u"), F.col("p").alias("a")), "u").join(up.select(F.col("n").alias("v"), F.col("p").alias("b")), "v")
        left = materialize(_edges(to.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    if nodes is None:
        kind = edges.schema["u"].dataType
        return edges.select(F.col("u").cast(kind).alias("node"), F.col("u").cast(kind).alias("component")).limit(0)
    return nodes

"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def connected(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of all ends of the undirected `edges`; component is the smallest node reachable.

    In every round each node with a smaller neighbour hooks on to the smallest
    one, trees are flattened by doubling, and edges are drawn anew between the
    roots.  A root that is left is smaller than all its neighbours, so at least
    half of the roots that have edges go in each round, whatever the shape: a
    path needs as many rounds as its length has digits, a star one or two.
    Minima are combined before they are shuffled, and a node of very many edges
    meets only joins of stored tables, which adaptive execution splits.  Edges
    with a null end and loops are left out.
    """
    a, b = F.col(u), F.col(v)
    edges = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    labels = None
    while labels is None or not edges.isEmpty():
        parent = cut(edges.groupBy("u").agg(F.min("v").alias("p")))
        while True:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            step = cut(parent.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            parent = step.select("u", "p")
            if step.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent
        else:
            moved = labels.withColumnsRenamed({"u": "node", "p": "u"}).join(parent, "u", "left").select(F.col("node").alias("u"), F.coalesce("p", "u").alias("p"))
            labels = cut(moved.unionByName(parent))
        of_v = parent.select(F.col("u").alias("v"), F.col("p").alias("q"))
        drawn = edges.join(parent, "u").join(of_v, "v", "left").select(F.col("p").alias("a"), F.coalesce("q", "v").alias("b"))
        edges = cut(drawn.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    found = labels.select(F.col("u").alias("node"), F.col("p").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())

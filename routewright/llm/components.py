"""Connected components by contraction.

Every node hooks onto its smallest neighbour if that is smaller, chains are
shortened until each node knows its root, and the graph is contracted to its
roots, until no edge is left. Ids are digests, so chains are short, and a hub
with very many links is met by partial minima and joins that split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewright.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of (a, b): root is the same for all nodes that a path joins.

    Loops and repeated edges do no harm; nodes without an edge have no row.
    """
    found = None
    edges = cut_lineage(edges.select("a", "b").where("a <> b").distinct())
    while True:
        parents = _roots(edges)
        found = parents if found is None else _follow(found, parents)
        a, b = parents.toDF("a", "ra"), parents.toDF("b", "rb")
        edges = cut_lineage(
            edges.join(a, "a").join(b, "b").where("ra <> rb")
            .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        )
        if edges.isEmpty():
            return cut_lineage(found)


def _roots(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("low"))
    parents = cut_lineage(low.select(F.col("a").alias("node"), F.least("a", "low").alias("root")))
    while True:
        step = cut_lineage(
            parents.join(parents.toDF("root", "above"), "root")
            .select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved"))
        )
        parents = step.drop("moved")
        if step.where("moved").isEmpty():
            return parents


def _follow(found: DataFrame, parents: DataFrame) -> DataFrame:
    return found.join(parents.toDF("root", "above"), "root", "left").select(
        "node", F.coalesce("above", "root").alias("root")
    )

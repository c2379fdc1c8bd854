"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): the smallest node it is connected with.

    Each round joins every node to the smallest of itself and its neighbours and keeps
    the links that are left between joined nodes, so a chain shrinks by a factor as a star
    does. Rounds are stored in the shared folder; nothing but counts reaches the driver.
    """
    edges = links.select("u", "v").where("u <> v").distinct().checkpoint()
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    roots = nodes.select("node", F.col("node").alias("root")).checkpoint()
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        step = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")).checkpoint()
        roots = roots.join(step, roots.root == step.u, "left").select("node", F.coalesce("to", "root").alias("root")).checkpoint()
        to_u, to_v = step.toDF("u", "a"), step.toDF("v", "b")
        edges = edges.join(to_u, "u").join(to_v, "v").where("a <> b").select(
            F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().checkpoint()
    return roots

"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node reachable from every node that has an edge.

    ``edges`` has columns ``a`` and ``b`` (each link once, in either direction). Every round takes the
    smallest root among a node's neighbours and then the root of its root, so paths shorten as
    powers of two. A round is written to the shared folder, so its lineage stays short.
    """
    both = saved(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    roots = saved(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "roots")
    for _ in range(rounds):
        seen = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        nearer = roots.join(seen.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("root").alias("was"), F.least("root", "near").alias("mid")
        )
        nearer = saved(nearer, "nearer")
        above = nearer.select(F.col("node").alias("mid"), F.col("mid").alias("top"))
        step = saved(
            nearer.join(above, "mid").select("node", F.col("top").alias("root"), (F.col("top") != F.col("was")).alias("moved")),
            "roots",
        )
        roots = step.select("node", "root")
        if step.where("moved").isEmpty():
            return roots
    raise RuntimeError(f"components not settled after {rounds} rounds")

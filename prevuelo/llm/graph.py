"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prevuelo.llm.store import written


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node ``u``, stored, so that the join below can split a hot node."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m")), "stars")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the links (u, v); the component is its smallest node.

    Every round is written to the shared folder, so the plan does not grow and a lost executor costs one round. Each
    round counts a node's neighbours by partial sums and joins the result back; no node's neighbours are gathered.
    Loops and repeated links do no harm; a link with a null end counts for nothing; no links give no rows.
    """
    low, high = F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")
    edges = written(links.where("u <> v").select(high, low).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # larger neighbours of u go to the least of u and its neighbours
        large = both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = written(large.distinct(), "large")
        # smaller neighbours of u, and u, go to the smallest
        least = _least(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")

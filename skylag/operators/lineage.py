"""Upstream and downstream nodes of a table in a lineage graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylag.sources.scratch import materialize


def _reach(edges: DataFrame, node: str, depth: int, tail: str, head: str) -> DataFrame:
    """(node, depth) of everything within `depth` steps from tail to head."""
    spark = edges.sparkSession
    seen = [spark.range(1).select(F.lit(node).alias("node"), F.lit(0).alias("depth"))]
    for step in range(1, depth + 1):
        frontier = seen[-1].select(F.col("node").alias(tail))
        visited = reduce(DataFrame.unionAll, seen).select("node")
        # Stored per step: the plan stays flat and each join sees the frontier's size.
        found = materialize(
            edges.join(frontier, tail, "left_semi")
            .select(F.col(head).alias("node"))
            .distinct()
            .join(visited, "node", "left_anti")
            .withColumn("depth", F.lit(step)),
            "lineage",
        )
        if found.isEmpty():
            break
        seen.append(found)
    return reduce(DataFrame.unionAll, seen).where(F.col("depth") > 0)


def lineage(edges: DataFrame, node: str, depth: int = 3) -> DataFrame:
    """(node, direction, depth): shortest distances up to `depth`, both ways.

    `edges` holds (src, dst) with src upstream of dst; cycles are fine.
    """
    up = _reach(edges, node, depth, "dst", "src").withColumn("direction", F.lit("upstream"))
    down = _reach(edges, node, depth, "src", "dst").withColumn("direction", F.lit("downstream"))
    return up.unionAll(down).select("node", "direction", "depth")

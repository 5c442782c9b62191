"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata.llm.common import stage


def components(links: DataFrame, source: str, target: str) -> DataFrame:
    """Smallest reachable value per linked value: columns ``node``, ``root``; only values that occur in a link.

    Every link is kept as a pointer from the larger to the smaller end. A round sends all pointers of a node, and the node
    itself, to the smallest of them, and skips over targets that point on. It ends when each node has one pointer and no target
    points anywhere, that is when all are roots. Each round is stored; a node's pointers meet as aggregates, never as a list.
    """
    pointers = links.filter(F.col(source) != F.col(target)).select(
        F.greatest(source, target).alias("node"), F.least(source, target).alias("root")
    ).distinct()
    pointers = stage(pointers, "links")
    while True:
        least = stage(pointers.groupBy("node").agg(F.min("root").alias("least"), F.count(F.lit(1)).alias("n")), "least")
        several = least.filter("n > 1").isEmpty()
        chained = pointers.join(least.select(F.col("node").alias("root")), "root", "left_semi").isEmpty()
        if several and chained:
            break
        met = pointers.join(least.select("node", "least"), "node")
        moved = met.select("node", F.col("least").alias("root")).unionByName(
            met.filter("root != least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        )
        onward = least.select(F.col("node").alias("root"), F.col("least").alias("next"))
        moved = moved.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        pointers = stage(moved.filter("node != root").distinct(), "links")
    roots = least.select("node", F.col("least").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

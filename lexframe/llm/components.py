"""Connected components of an edge table by alternating large and small stars.

The smallest neighbour of every node is written before it is joined to the edges again, so both sides of a join are plain
shuffles and adaptive execution may split a node with many neighbours over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.session import pin


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node that is not the root, the smallest node, of its component.

    ``links`` has the long columns ``a`` and ``b``; loops and repeated rows do not matter, no link gives no row.
    """
    edges = pin(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars"
    )
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(state) == before or not state["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pin(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars-least")
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = pin(large.distinct(), "stars")
        least = pin(large.groupBy("u").agg(F.min("v").alias("m")), "stars-least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = pin(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")

"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is the least node of its component.

    Each round every node points to its least neighbour or itself, pointers are followed until all
    reach a local least node, and the graph is contracted to those; the nodes of a component at
    least halve, so the rounds grow with the logarithm of its size. Null ends are dropped. Rounds
    run as jobs while this function runs; each writes its small tables to the shared folder.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    labels = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "labels")
    rest = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        up = both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("low")).select("x", F.least("x", "low").alias("up"))
        up = written(up, "pointers")
        while True:
            then = up.select(F.col("x").alias("up"), F.col("up").alias("next"))
            jumped = written(up.join(then, "up").select("x", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "pointers")
            up = jumped.select("x", "up")
            if jumped.where("moved").isEmpty():
                break
        onto = up.select(F.col("x").alias("root"), F.col("up").alias("to"))
        labels = written(labels.join(onto, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        left = rest.join(up.select(F.col("x").alias("a"), F.col("up").alias("a2")), "a").join(up.select(F.col("x").alias("b"), F.col("up").alias("b2")), "b")
        rest = written(left.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
    return labels

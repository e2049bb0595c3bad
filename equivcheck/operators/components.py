"""Connected components of a table of links between numbered nodes.

Every node takes the least label among its neighbours', then the label of its label, until nothing
changes; the second step halves the way to go, so chains take few rounds.  Labels are aggregated
before they are shuffled, and each round is written, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equivcheck.session import written


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, label)`` of every row of ``nodes (node)``; ``links (a, b)`` count in both directions.

    The label is the least node of the component.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a != b").distinct(), "links")
    now = written(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        seen = both.join(now.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = now.join(seen.withColumnRenamed("a", "node"), "node", "left")
        least = least.select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        least = written(least, "labels")
        ahead = least.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = least.join(ahead, "label").select("node", "old", F.least("label", "far").alias("label"))
        moved = written(moved, "labels")
        if moved.where("label != old").isEmpty():
            return moved.select("node", "label")
        now = moved.select("node", "label")

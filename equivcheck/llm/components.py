"""Connected components of a graph that is given as a table of links.

Large-star and small-star steps in turn: each is an aggregation (partial before its shuffle, so a
hub arrives as one row per task) and a join that Spark may split where a hub makes it uneven.
Every step is written to the shared folder, so lineage stays short and lost executors cost one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equivcheck.session import written


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = _least_neighbour(links)
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` of every node with a link to another one; the root is the least node.

    Links with a null end or from a node to itself are ignored.  No links give no rows.
    """
    high, low = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    ends = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    now = written(links.where(ends).select(high.alias("u"), low.alias("v")).distinct(), "links")
    state = _state(now)
    while state[0]:
        now = written(_small_star(_large_star(now)), "links")
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

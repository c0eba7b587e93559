"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Every
round is a grouped minimum and a join on the node, so a hub with many links is
pre-aggregated and its rows are split by adaptive execution; no neighbour list
is gathered.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.bounded import materialise


def _least(pairs: DataFrame) -> DataFrame:
    """For (u, v): the smallest v of each u, itself included."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return least.select(F.col("u").alias("k"), F.least("u", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(_least(both), F.col("u") == F.col("k"))
    return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    linked = down.join(least, F.col("u") == F.col("k"))
    own = least.select(F.col("k").alias("u"), F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the long pairs (u, v); root is the smallest node reachable.

    Self links are ignored; nodes without links are absent.  An empty table gives no rows.
    """
    stars = materialise(edges.select("u", "v").where("u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        stars = materialise(_small(_large(stars)), "stars")
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

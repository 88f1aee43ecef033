"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame) -> DataFrame:
    """(src long, dst long) → (node, root): root is the smallest node reachable.

    Alternates large-star and small-star rounds until the edges stop changing; every
    round is a group-by minimum and a join on the node, checkpointed to the shared
    folder.  Loops and repeated edges are allowed, an edge with a null end is ignored;
    an empty table gives an empty result.  Only a count and a checksum per round reach
    the driver.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    cur = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct().checkpoint()
    state = _state(cur)
    while state[0]:
        cur = _small_star(_large_star(cur)).checkpoint()
        new = _state(cur)
        if new == state:
            break
        state = new
    # every edge now leads from a node to its root
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    kept = edges.join(least, "u")
    return (kept.select("u", F.col("m").alias("v"))
            .union(kept.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .where("u <> v").distinct())

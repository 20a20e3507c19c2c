"""Connected components of a link table, by alternating stars.

Each round turns every node's larger neighbours, then its smaller ones, towards its smallest neighbour, until every node hangs directly on the smallest
id of its component. Minima are summed map-side, so a node with a third of all links is one row per task there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import stored

MOST_ROUNDS = 60


def _turned(links: DataFrame, larger: bool) -> DataFrame:
    """One star step over links (a, b) with a > b."""
    around = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        around = around.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    joined = around.join(least, "u")
    if larger:  # every larger neighbour hangs on the smallest one
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("low").alias("b"))
    else:  # every smaller neighbour, and the node itself
        moved = joined.select(F.col("v").alias("a"), F.col("low").alias("b")).union(least.select(F.col("u").alias("a"), F.col("low").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every id in a link between two different ids; root is the smallest id reachable."""
    now = stored(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), "links")
    mark = None
    for _ in range(MOST_ROUNDS):
        now = stored(_turned(_turned(now, True), False), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())

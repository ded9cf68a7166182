"""Connected components of an edge table, by alternating stars.

Each round connects every node's larger neighbours to its smallest one (large
star), then its smaller neighbours (small star); after about log(n) rounds
every component is one star around its smallest node. Rounds are joins and
grouped minima; each is written to the shared checkpoint folder, so lineage
stays short. Edges never reach the driver: it sees a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svcops.session import settled

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` lead from the larger node u to the smaller node v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node that has an edge to another and isn't
    itself the smallest of its component; edges may repeat, be loops or lead
    either way; null ends are ignored."""
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    now = settled(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
                  .where(x.isNotNull() & y.isNotNull() & (x != y)).distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        now = settled(_small_star(_large_star(now)))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")

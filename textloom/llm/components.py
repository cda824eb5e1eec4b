"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouping for the smallest neighbour and a join, so no node's
neighbourhood is gathered.  The smallest neighbours are written before the join: then
both its sides are plain shuffles, which can be split where one node has very many edges.
Each round is written to the shared folder, and the loop ends when a round leaves the
edges as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.storage import save

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """(u > v) edges: every node hands its smallest neighbour to its larger neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "component-smallest")
    return both.where(F.col("v") > F.col("u")).join(smallest.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """(u > v) edges: every node hands its smallest neighbour to itself and its smaller ones."""
    smallest = save(edges.groupBy("u").agg(F.min("v").alias("m")), "component-smallest")
    joined = edges.join(smallest.hint("merge"), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) long edges to (node, component): the smallest node of each component.

    Loops and repeated edges do no harm; null ends are dropped.  Nodes without an
    edge do not appear."""
    ordered = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = save(ordered.distinct(), "component-edges")
    was = None
    for _ in range(MAX_ROUNDS):
        n, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == was:
            break
        was = (n, total)
        star = _small_star(_large_star(now).distinct()).where(F.col("u") != F.col("v")).distinct()
        now = save(star, "component-edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

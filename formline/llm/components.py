"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.session import write_and_reload


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of each node on the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return both.filter("v > u").join(lows, "u").select(F.col("v").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them."""
    lows = edges.groupBy("a").agg(F.min("b").alias("low"))
    inner = edges.join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
    return inner.union(lows.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint, undirected); component is the smallest node.

    Loops, repeated and null edges are ignored. Each round is written to the shared folder, which cuts the lineage and
    survives lost executors. Hubs are joins on the node, which Spark splits when skewed; no neighbour list is ever collected.
    """
    clean = edges.filter("a is not null and b is not null and a <> b")
    edges = write_and_reload(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select("b", "b").distinct()
            )
        before = state
        edges = write_and_reload(_small_star(_large_star(edges)), "stars")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

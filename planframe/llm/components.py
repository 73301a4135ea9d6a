"""Connected components by alternating large-star and small-star rounds over a DataFrame of edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planframe.llm.common import hot_join, settle, unsettle


def _star(edges: DataFrame, large: bool, count: int) -> DataFrame:
    """One round over ``count`` edges. Every node links its larger (large-star) or smaller (small-star) neighbours to the least node near it."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n")).select("u", F.least("u", "_m").alias("m"), "_n")
    joined = hot_join(near, least, ["u"], "_n", 2 * count if large else count)
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select("v", "m", "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): for each node of ``edges(u, v)`` the least node that it reaches.

    Nodes without an edge have no row. Self-loops, nulls and repeated edges are passed over. Each round is
    a grouped minimum and a join on the node, both of which Spark deals out; the edges of a hub stay where
    they are and its minimum is broadcast. Nothing but row counts and a checksum comes to the driver.
    """
    now = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    count, seen = now.count(), None
    for _ in range(rounds):
        large = settle(_star(now, True, count), "edges")  # at most as many edges as there were
        new = settle(_star(large, False, count), "edges")
        unsettle(now)
        unsettle(large)
        now = new
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen, count = tuple(state), state[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

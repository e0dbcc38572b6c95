"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import forget, settle


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected graph with the smallest node it reaches.

    ``edges`` has two columns of one orderable type. Returns one row per node that has an edge: ``node``,
    ``component``. Loops, repeated edges and edges with a null end are allowed and ignored; no edges give no rows.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest neighbour (the
    large-star / small-star scheme of Kiveris et al., 2014), so the rounds grow with the logarithm of the longest
    path, not with the size of the graph. Neighbour minima are pre-aggregated before they move. Minima and edges
    meet in a join of two written tables, so that the adaptive planner may split a hub's edges among tasks; nothing
    is gathered per node and nothing but the number of changed edges reaches the driver.
    """
    edge = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = settle(edge.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    stamp = _stamp(now)
    for _ in range(max_rounds):
        if stamp[0] == 0:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        big = settle(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        forget(low)
        low = settle(big.groupBy("u").agg(F.min("v").alias("m")))
        hung = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = settle(hung.union(low.select("u", F.col("m").alias("v"))).distinct())
        forget(low)
        forget(big)
        forget(now)
        now, old, stamp = new, stamp, _stamp(new)
        if stamp == old:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _stamp(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.session import cut, drop_cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node's larger (or smaller) neighbours are tied to the smallest node among all of them."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if large else both.where("v < u")
    low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))  # partial sums carry hot nodes
    if large:
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = around.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the component's smallest node. Ends when nothing changes."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(limit):
        nxt = cut(_stars(_stars(now, True), False), "edges")
        drop_cut(now)
        now = nxt
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (got["n"], got["h"]) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = (got["n"], got["h"])
    raise RuntimeError(f"components did not settle in {limit} rounds")

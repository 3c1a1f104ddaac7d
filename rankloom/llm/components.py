"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import drop_tables, staged, tables_mark, tables_since


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for all nodes of ``edges``
    (u, v: long) but the roots themselves.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each node's
    neighbours are pointed at the smallest of them, until every component is one star.
    A round is grouped minima and joins only, so no task holds a node's neighbours, and
    its edges are staged, so the plan stays short and executors may be lost.
    """
    spark = edges.sparkSession
    mark = tables_mark()
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen, total = None, now.count()
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both.where("v > u"), _least(both), total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)
        pointed = _with_least(large, small, total).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        before = tables_since(mark)
        now = staged(pointed.where("u <> v").distinct(), "edges")
        drop_tables(spark, before)
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == state:
            break
        seen, total = state, state["n"]
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _least(edges: DataFrame) -> DataFrame:
    """Each node with the smallest of itself and its neighbours, and its degree."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")


#: A node is a hub if it has more than this share of all edge ends.
HUB_SHARE, HUB_LEAST = 1000, 256


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` with their u's smallest neighbour ``m``. Edges of hubs stay where they lie: there are at most
    HUB_SHARE hubs, so these are broadcast; all other nodes are joined by key and none holds many edges."""
    limit = max(HUB_LEAST, 2 * total // HUB_SHARE)
    hubs = least.where(F.col("degree") > limit).select("u", F.col("m").alias("hub"))
    marked = edges.join(F.broadcast(hubs), "u", "left")
    others = least.where(F.col("degree") <= limit).select("u", "m")
    return marked.where("hub IS NOT NULL").select("u", "v", F.col("hub").alias("m")).unionByName(marked.where("hub IS NULL").select("u", "v").join(others, "u"))

"""Connected components of a graph of any size, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import common
from .common import by_shuffle, cut, release


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b: long) that isn't the smallest of its own.

    Each round first hangs the larger neighbours of every node on its smallest neighbour, then the smaller ones; both
    keep what is connected connected and never add edges. Rounds number about the logarithm of the longest chain. A node
    with very many larger neighbours, as the centres of stars become, meets them through a broadcast of its minimum, so
    that they needn't come together in one task; there are MOST_HOT such nodes at most. Null ends and loops are no
    edges; without edges there is no row.
    """
    spark = edges.sparkSession
    u, v = F.col("u"), F.col("v")
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = cut(now, "edges")
    hot_at = max(common.HOT_ROWS, -(-now.count() // common.MOST_HOT))

    def look(now: DataFrame) -> Row:
        """Number and hash of the edges, and the nodes with hot_at larger neighbours or more."""
        each = now.groupBy("v").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        return each.agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.collect_list(F.when(F.col("n") >= hot_at, v)).alias("hot")).first()

    seen = look(now)
    for _ in range(most_rounds):
        sides = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = sides.filter(v > u)
        met = larger.join(by_shuffle(least), "u") if not seen["hot"] else None
        if met is None:
            hot = F.broadcast(spark.createDataFrame([(x,) for x in seen["hot"]], "u long"))
            met = larger.join(F.broadcast(least.join(hot, "u")), "u").unionByName(larger.join(hot, "u", "left_anti").join(by_shuffle(least), "u"))
        large = met.select(v.alias("u"), F.col("m").alias("v")).filter(u > v).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u").select(F.explode(F.array(F.struct(u.alias("u"), F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))).alias("e"))
        before, now = now, cut(pairs.select("e.u", "e.v").filter(u > v).distinct(), "edges")
        release(before)
        last, seen = seen, look(now)
        if (seen["n"], seen["h"]) == (last["n"], last["h"]):
            return now.select(u.alias("node"), v.alias("component"))
    raise RuntimeError(f"no end after {most_rounds} rounds")

"""Common questions asked of a graph, as plans: usage of attributes, neighbours, orders, cycles and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..model import Attributes, PGraph


def attribute_usage(graph: PGraph, kind: str = "node") -> DataFrame:
    """attribute, n: how many elements have each attribute."""
    columns = graph.columns_of(kind)
    held = F.map_keys("attrs")
    if columns:
        held = F.concat(held, F.filter(F.array(*(F.when(Attributes(columns).has(n), F.lit(n)) for n in columns)), lambda x: x.isNotNull()))
    return graph.table_of(kind).select(F.explode(held).alias("attribute")).groupBy("attribute").agg(F.count("*").alias("n"))


def neighbours(graph: PGraph, node_id: str) -> DataFrame:
    """id of every node that an edge from node_id leads to."""
    return graph.edges.filter(F.col("src") == node_id).select(F.col("dst").alias("id")).distinct()


def adjacency(graph: PGraph) -> DataFrame:
    """id, neighbours (sorted, each once) of every node with an edge from it."""
    return graph.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def topological_levels(graph: PGraph) -> DataFrame:
    """id, level: the longest way to a node from one that no edge leads to. Nodes in or behind cycles have none.

    Levels are peeled: a node is free once as many edges into it are gone as there are. A round writes the nodes that it
    touches and no more; the edges are written anew when half of them are gone.
    """
    edges = cut(graph.edges.select("src", "dst").distinct())
    into = cut(edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")))
    free = cut(graph.nodes.select("id").join(into, "id", "left_anti"))
    levels, waiting, gone, level = [free.withColumn("level", F.lit(0))], None, [], 0
    left = written = edges.count()
    while not free.isEmpty() and left:
        level += 1
        met = edges.join(free.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("met"))
        got = met if waiting is None else met.join(waiting.withColumnRenamed("got", "before"), "id", "left").select("id", "met", "before")
        before = F.lit(0) if waiting is None else F.coalesce("before", F.lit(0))
        touched = cut(got.join(into, "id").select("id", "met", (F.col("met") + before).alias("got"), "n"))
        left -= touched.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("n")).first()["n"]
        gone.append(free)
        free = touched.filter("got = n").select("id")
        partly = touched.filter("got < n").select("id", "got")
        waiting = partly if waiting is None else cut(waiting.join(touched.select("id"), "id", "left_anti").unionByName(partly))
        levels.append(free.withColumn("level", F.lit(level)))
        if 2 * left < written:
            edges = cut(edges.join(reduce(DataFrame.unionByName, gone).withColumnRenamed("id", "src"), "src", "left_anti"))
            gone, written = [], left
        if len(levels) >= 12:
            levels = [cut(reduce(DataFrame.unionByName, levels))]
    return reduce(DataFrame.unionByName, levels)


def topological_order(graph: PGraph) -> list[str]:
    """Ids by level, then by id; an error if there is a cycle. The order is a list, so it is made on the driver."""
    found = [r["id"] for r in topological_levels(graph).orderBy("level", "id").collect()]
    if len(found) < graph.nodes.count():
        raise ValueError("the graph has a cycle")
    return found


def has_cycle(graph: PGraph) -> bool:
    return not graph.nodes.select("id").join(topological_levels(graph), "id", "left_anti").isEmpty()


def simple_paths(graph: PGraph, start: str, end: str, most: int | None = None) -> DataFrame:
    """path (array of ids): every way from start to end that meets no node twice; with `most`, of so many edges at most."""
    steps = cut(graph.edges.select(F.col("src").alias("_at"), F.col("dst").alias("_next")).distinct())
    now = graph.spark.range(1).select(F.lit(start).alias("_at"), F.array(F.lit(start)).alias("path"))
    done = [now.filter(F.col("_at") == end).select("path")]
    now = now.filter(F.col("_at") != end)
    while most is None or len(done) <= most:
        now = cut(now.join(steps, "_at").filter(~F.array_contains("path", F.col("_next"))).select(F.col("_next").alias("_at"), F.concat("path", F.array("_next")).alias("path")))
        if now.isEmpty():
            break
        done.append(now.filter(F.col("_at") == end).select("path"))
        now = now.filter(F.col("_at") != end)
    return reduce(DataFrame.unionByName, done)

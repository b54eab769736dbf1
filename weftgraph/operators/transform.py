"""Changes to attributes, removal of edges and orphans, and contraction of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import column_of
from ..model import ATTRS, PREFIX, Attributes, PGraph, literal, no_attrs, no_sets, pack
from ..plans import query_text as q
from .select import matching_nodes
from .traverse import ends


def _checked(pred: object) -> object:
    if pred.target == "mixed":
        raise q.QueryError("a predicate can't be on nodes and edges at once")
    return pred


def make(graph: PGraph, stage: q.Make) -> PGraph:
    """Sets an attribute where the predicate holds; a predicate on the other kind of element changes nothing."""
    pred = _checked(stage.pred)
    if pred.target not in ("", stage.kind):
        return graph
    columns = graph.columns_of(stage.kind)
    if stage.name in columns and columns[stage.name] != pack(stage.value)[0]:
        graph = graph.in_map(stage.kind, {stage.name})
        columns = graph.columns_of(stage.kind)
    holds = column_of(pred, stage.kind, Attributes(columns))
    table = graph.table_of(stage.kind)
    if stage.name in columns:
        name = PREFIX + stage.name
        return graph.with_table(stage.kind, table.withColumn(name, F.when(holds, F.lit(stage.value)).otherwise(F.col(f"`{name}`"))))
    others = F.map_filter("attrs", lambda k, _: k != stage.name)
    written = F.map_concat(others, F.create_map(F.lit(stage.name), literal(stage.value)).cast(ATTRS))
    return graph.with_table(stage.kind, table.withColumn("attrs", F.when(holds, written).otherwise(F.col("attrs"))))


def remove_attribute(graph: PGraph, stage: q.RemoveAttribute) -> PGraph:
    pred = _checked(stage.pred)
    if pred.target not in ("", stage.kind):
        return graph
    columns = graph.columns_of(stage.kind)
    holds = column_of(pred, stage.kind, Attributes(columns))
    table = graph.table_of(stage.kind)
    if stage.name in columns:
        name = PREFIX + stage.name
        return graph.with_table(stage.kind, table.withColumn(name, F.when(~holds, F.col(f"`{name}`"))))
    return graph.with_table(stage.kind, table.withColumn("attrs", F.when(holds, F.map_filter("attrs", lambda k, _: k != stage.name)).otherwise(F.col("attrs"))))


def remove_edges(graph: PGraph, stage: q.RemoveEdges) -> PGraph:
    """Drops matching edges; nodes stay. A predicate on nodes drops none."""
    pred = _checked(stage.pred)
    if pred.target == "node":
        return graph
    return graph.with_(edges=graph.edges.filter(~column_of(pred, "edge", Attributes(graph.edge_columns))))


def remove_orphans(graph: PGraph) -> PGraph:
    """Drops nodes that no edge touches."""
    return graph.with_(nodes=graph.nodes.join(ends(graph.edges), "id", "left_semi"))


def _shown(value: Column) -> Column:
    """A value without its type, as contraction compares attributes: number 1 and string "1" are the same there."""
    whole = (value["n"] == F.floor(value["n"])) & (F.abs(value["n"]) < 1e15)
    number = F.when(whole, value["n"].cast("decimal(38,0)").cast("string")).otherwise(value["n"].cast("string"))
    return F.coalesce(value["s"], number, value["b"].cast("string"), F.lit("<nil>"))


def collapse(graph: PGraph, stage: q.Collapse) -> PGraph:
    """Contracts the matching nodes into one node with their merged attributes, in ascending order of id, and no sets.

    Edges inside go, others are redirected; all edges lose label, parent and scope, and of edges with equal ends and
    attributes the first stays. Without a match the graph stays as it is.
    """
    pred = _checked(stage.pred)
    if pred.target == "edge":
        raise q.QueryError("collapse takes a predicate on nodes")
    found = matching_nodes(graph, pred)
    if found.isEmpty():
        return graph
    last = [F.max_by(F.col(f"`{PREFIX}{n}`"), F.when(F.col(f"`{PREFIX}{n}`").isNotNull(), F.col("id"))).alias(PREFIX + n) for n in graph.node_columns]
    entries = found.select("id", F.explode("attrs").alias("k", "v")).groupBy("k").agg(F.max_by("v", "id").alias("v"))
    attrs = entries.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).cast(ATTRS).alias("attrs"))
    one = found.agg(F.lit(stage.into).alias("id"), *last).crossJoin(F.broadcast(attrs))  # one row each
    one = one.select("id", F.lit(None).cast("string").alias("parent"), no_sets().alias("sets"), F.coalesce("attrs", no_attrs()).alias("attrs"), *(F.col(f"`{PREFIX}{n}`") for n in graph.node_columns))
    kept = graph.nodes.filter(~column_of(pred, "node", Attributes(graph.node_columns)) & (F.col("id") != stage.into))
    ids = found.select("id")
    edges = _redirected(graph.edges, ids, stage.into)
    columns = graph.edge_columns
    shown = [F.concat(F.lit(f"{n}:"), _shown(Attributes(columns).value(n))) for n in columns]
    in_map = F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit(":"), _shown(e["value"])))
    key = F.array_sort(F.filter(F.concat(in_map, F.array(*shown)) if shown else in_map, lambda x: x.isNotNull()))
    edges = edges.withColumn("_key", key).groupBy("src", "dst", "_key").agg(F.min_by(F.struct(*edges.columns), "ord").alias("_e")).select("_e.*")
    return graph.with_(nodes=kept.unionByName(one), edges=edges)


def _redirected(edges: DataFrame, ids: DataFrame, into: str) -> DataFrame:
    names = edges.columns
    for end in ("src", "dst"):
        inside = ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}"))
        edges = edges.join(inside, end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", F.lit(False)))
    edges = edges.filter(~(F.col("_src") & F.col("_dst")))
    blank = {"label": F.lit(""), "parent": F.lit(""), "scope_depth": F.lit(0), "src": F.when(F.col("_src"), into).otherwise(F.col("src")), "dst": F.when(F.col("_dst"), into).otherwise(F.col("dst"))}
    return edges.select(*(blank[c].alias(c) if c in blank else F.col(f"`{c}`") for c in names))

"""Extraction of subgraphs by a predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import column_of, uses_depth
from ..model import Attributes, PGraph
from ..plans import query_text as q
from .traverse import ends, induced, traverse, with_depth


def matching_nodes(graph: PGraph, pred: object) -> DataFrame:
    return graph.nodes.filter(column_of(pred, "node", Attributes(graph.node_columns)))


def matching_edges(graph: PGraph, pred: object) -> DataFrame:
    """Edges for which pred holds, with depths walked in full and "depends on" resolved where it stands at the top."""
    attributes = Attributes(graph.edge_columns)
    edges = with_depth(graph.edges) if uses_depth(pred) else graph.edges
    depth = F.col("_depth") if uses_depth(pred) else None
    if not isinstance(pred, q.DependsOn):
        return edges.filter(column_of(pred, "edge", attributes, depth)).select(*graph.edges.columns)
    # The first edge with a label stands for it; the predicate is evaluated on those, and met by a join on labels.
    first = edges.filter("label <> ''").groupBy("label").agg(F.min_by(F.struct(*edges.columns), "ord").alias("_e")).select("_e.*")
    good = first.filter(column_of(pred.inner, "edge", attributes, depth)).select(F.col("label").alias("parent"))
    return graph.edges.filter("parent <> ''").join(good, "parent", "left_semi").select(*graph.edges.columns)


def subgraph(graph: PGraph, stage: q.Subgraph) -> PGraph:
    """What a predicate selects, and what a walk from there gathers.

    On nodes: those nodes and the edges between them. On edges: those edges and their ends. On neither: nodes if any
    match, else the ends of the matching edges if any do, else every node; and the edges between them.
    """
    pred = stage.pred
    if pred.target == "mixed":
        raise q.QueryError("a predicate can't be on nodes and edges at once")
    if pred.target == "edge":
        found = matching_edges(graph, pred)
        if stage.directions:
            return traverse(graph, ends(found), stage.directions, stage.depth)
        return graph.with_(nodes=graph.nodes.join(ends(found), "id", "left_semi"), edges=found)
    ids = matching_nodes(graph, pred).select("id")
    if pred.target == "":
        if pred == q.Always():  # no need to look
            ids = graph.nodes.select("id")
        elif ids.isEmpty():
            found = matching_edges(graph, pred)
            ids = graph.nodes.select("id") if found.isEmpty() else ends(found)
    return traverse(graph, ids, stage.directions, stage.depth) if stage.directions else induced(graph, ids)



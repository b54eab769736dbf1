"""Single changes to a graph: adding, replacing and removing elements by rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EDGES, GROUPS, NODES, PGraph
from ..plans.query_text import QueryError
from .algebra import _after


def _plain(graph: PGraph) -> PGraph:
    return graph.in_map("node").in_map("edge")


def _without(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.join(rows.select("id"), "id", "left_anti").select(*table.columns)


def add_nodes(graph: PGraph, rows: DataFrame) -> PGraph:
    """Nodes (id, attrs, sets, parent) that aren't there yet; a node that is there stays as it is."""
    graph, rows = _plain(graph), rows.select(*NODES.names).dropDuplicates(["id"])
    return graph.with_(nodes=graph.nodes.select(*NODES.names).unionByName(_without(rows, graph.nodes)))


def put_nodes(graph: PGraph, rows: DataFrame) -> PGraph:
    """Nodes as they are given; a node that is there is replaced."""
    graph, rows = _plain(graph), rows.select(*NODES.names)
    return graph.with_(nodes=_without(graph.nodes.select(*NODES.names), rows).unionByName(rows))


def add_sets(graph: PGraph, rows: DataFrame) -> PGraph:
    """Sets (id, attrs, declared) that aren't there yet."""
    rows = rows.select(*GROUPS.names).dropDuplicates(["id"])
    return graph.with_(sets=graph.sets.select(*GROUPS.names).unionByName(_without(rows, graph.sets)))


def put_sets(graph: PGraph, rows: DataFrame) -> PGraph:
    """Sets as they are given; a set that is there is replaced."""
    rows = rows.select(*GROUPS.names)
    return graph.with_(sets=_without(graph.sets.select(*GROUPS.names), rows).unionByName(rows))


def put_edges(graph: PGraph, rows: DataFrame) -> PGraph:
    """Edges as they are given, in their order, after all that are there; ends needn't be nodes."""
    graph = _plain(graph)
    edges = graph.edges.select(*EDGES.names)
    return graph.with_(edges=edges.unionByName(_after(rows.select(*EDGES.names), edges)))


def add_edges(graph: PGraph, rows: DataFrame) -> PGraph:
    """As put_edges, but an end that is no node is an error."""
    ends = rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    if lost := ends.join(graph.nodes.select("id"), "id", "left_anti").first():
        raise QueryError(f"no node {lost['id']!r}")
    return put_edges(graph, rows)


def remove_node(graph: PGraph, node_id: str) -> PGraph:
    """Without a node that no edge touches; one that isn't there, or has edges, is an error."""
    if graph.get(node_id).isEmpty():
        raise QueryError(f"no node {node_id!r}")
    if not graph.edges.filter((F.col("src") == node_id) | (F.col("dst") == node_id)).isEmpty():
        raise QueryError(f"node {node_id!r} has edges")
    return graph.with_(nodes=graph.nodes.filter(F.col("id") != node_id))


def remove_edge(graph: PGraph, src: str, dst: str) -> PGraph:
    """Without the first edge from src to dst; it is an error if there is none."""
    first = graph.edges.filter((F.col("src") == src) & (F.col("dst") == dst)).agg(F.min("ord").alias("ord")).first()["ord"]
    if first is None:
        raise QueryError(f"no edge {src!r} -> {dst!r}")
    return graph.with_(edges=graph.edges.filter(F.col("ord") != first))


def with_state(graph: PGraph, nodes: DataFrame | None = None, edges: DataFrame | None = None, sets: DataFrame | None = None) -> PGraph:
    """The graph with whole tables replaced, unchecked; None leaves a table as it is."""
    graph = _plain(graph)
    return graph.with_(nodes=graph.nodes if nodes is None else nodes.select(*NODES.names), edges=graph.edges if edges is None else edges.select(*EDGES.names), sets=graph.sets if sets is None else sets.select(*GROUPS.names))

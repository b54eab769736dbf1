"""Running queries: analysis, rewrites on the tree of stages, and the stages as plans over a graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.lineage import cut
from ..model import PGraph
from . import query_text as q


@dataclass
class Context:
    """The input graph and the graphs bound so far; one context may serve several queries."""

    input: PGraph
    named: dict[str, PGraph] = field(default_factory=dict)
    settled: set[str] = field(default_factory=set)
    slim: dict[str, PGraph] = field(default_factory=dict)


def fused(stages: tuple) -> tuple:
    """The same query with less to do: node filters in a row become one, and what a reset throws away isn't built.

    Only stages that can't fail are dropped, and bindings never are, so errors come as they would without this.
    """
    out: list = []
    for stage in stages:
        if isinstance(stage, q.From):
            while out and isinstance(out[-1], (q.RemoveOrphans, q.From)) and not (isinstance(out[-1], q.From) and out[-1].name != "*"):
                out.pop()
        if isinstance(stage, q.Subgraph) and out and isinstance(out[-1], q.Subgraph) and not stage.directions and not out[-1].directions and stage.pred.target == out[-1].pred.target == "node":
            # The second filter looks at attributes and memberships of nodes alone, which the first one leaves as they are.
            out[-1] = q.Subgraph(_and(out[-1].pred, stage.pred))
            continue
        out.append(stage)
    return tuple(out)


def _and(left: object, right: object) -> q.And:
    return q.And(left, right)


def run(context: Context, text: str) -> PGraph:
    """The graph that a query makes of the context's input; what it binds stays in the context."""
    return execute(context, q.parse(text))


def query(graph: PGraph, text: str) -> PGraph:
    return run(Context(graph), text)


def execute(context: Context, stages: tuple) -> PGraph:
    """Stages from the input graph on; a bound pipeline starts there too."""
    from ..operators import algebra, select, transform

    now = context.input

    def named(name: str) -> PGraph:
        if name == "*":
            return context.input
        if name not in context.named:
            raise q.QueryError(f"no graph is named {name}")
        return context.named[name]

    def settled(name: str) -> PGraph:
        """A bound graph, written once: where it is read several times, unwritten plans would multiply."""
        graph = named(name)
        if name != "*" and name not in context.settled:
            graph = context.named[name] = graph.with_(nodes=cut(graph.nodes), edges=cut(graph.edges))
            context.settled.add(name)
        return graph

    def slim(name: str) -> PGraph:
        """What the right side of & and - is asked for: ids and ends of edges, written once if the graph is a bound one."""
        graph = named(name)
        if name == "*" or name in context.settled:
            return graph
        if name not in context.slim:
            context.slim[name] = graph.with_(nodes=cut(graph.nodes.select("id")), edges=cut(graph.edges.select("src", "dst")), node_columns={}, edge_columns={})
        return context.slim[name]

    for stage in fused(stages):
        if isinstance(stage, q.Bind):
            if stage.name in context.named:
                raise q.QueryError(f"{stage.name} is bound already")
            context.named[stage.name] = execute(context, stage.stages)
        elif isinstance(stage, q.From):
            now = named(stage.name)
        elif isinstance(stage, q.Algebra):
            left, right = {"+": (named, named), "&": (named, slim), "-": (named, slim), "^": (settled, settled)}[stage.op]
            now = algebra.OPERATORS[stage.op](left(stage.left), right(stage.right))
        elif isinstance(stage, q.Subgraph):
            now = select.subgraph(now, stage)
        elif isinstance(stage, q.Make):
            now = transform.make(now, stage)
        elif isinstance(stage, q.RemoveAttribute):
            now = transform.remove_attribute(now, stage)
        elif isinstance(stage, q.RemoveEdges):
            now = transform.remove_edges(now, stage)
        elif isinstance(stage, q.RemoveOrphans):
            now = transform.remove_orphans(now)
        elif isinstance(stage, q.Collapse):
            now = transform.collapse(now, stage)
        else:
            raise TypeError(type(stage))
    return now

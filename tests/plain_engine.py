"""The query language over Python rows, one row at a time: what the Spark engine is held against."""

from __future__ import annotations

import copy

from weftgraph.model import EMPTY, NodeRef
from weftgraph.plans import query_text as q
from weftgraph.sources.definition import Definition, EdgeRow, NodeRow


def equal(a, b):
    return type(a) is type(b) and a == b


def holds(pred, kind, row, depth=None, depends=None):
    if isinstance(pred, q.Always):
        return pred.value
    if isinstance(pred, q.Not):
        return not holds(pred.inner, kind, row, depth)
    if isinstance(pred, q.And):
        return holds(pred.left, kind, row, depth) and holds(pred.right, kind, row, depth)
    if pred.target not in ("", kind):
        return False
    if isinstance(pred, q.Compare):
        if kind == "node" and pred.name == "id":
            return equal(row.id, pred.value) == pred.equal
        return pred.name in row.attrs and equal(row.attrs[pred.name], pred.value) == pred.equal
    if isinstance(pred, q.Has):
        return (pred.name in row.attrs) == pred.present
    if isinstance(pred, q.Member):
        return (pred.group in row.sets) == pred.inside
    if kind == "node":
        return False
    if isinstance(pred, q.HasParent):
        return bool(row.parent) == pred.present
    if isinstance(pred, q.Depth):
        return ((depth(row) if depth else int(bool(row.parent))) == pred.depth) == pred.equal
    return bool(depends and depends(row))


class Graph:
    def __init__(self, d: Definition):
        self.d = copy.deepcopy(d)

    def first(self):
        out = {}
        for e in self.d.edges:
            if e.label:
                out.setdefault(e.label, e)
        return out

    def last(self):
        return {e.label: e for e in self.d.edges if e.label}

    def depth(self, edge):
        index, n, met = self.last(), 0, set()
        while edge.parent:
            if edge.label:
                if edge.label in met:
                    return n
                met.add(edge.label)
            n += 1
            if edge.parent not in index:
                return n
            edge = index[edge.parent]
        return n

    def induced(self, ids):
        d = Definition({i: n for i, n in self.d.nodes.items() if i in ids}, [e for e in self.d.edges if e.src in ids and e.dst in ids], self.d.sets)
        return Graph(d)


def walk(g, ids, directions, depth):
    ids = set(ids)
    structure = [x for x in directions if x in ("in", "out", "both")]
    if structure:
        front = set(ids)
        for _ in range(depth):
            new = set()
            for e in g.d.edges:
                if {"out", "both"} & set(structure) and e.src in front:
                    new.add(e.dst)
                if {"in", "both"} & set(structure) and e.dst in front:
                    new.add(e.src)
            front = new - ids
            if not front:
                break
            ids |= front
    if any(x in ("up", "down") for x in directions):
        queue = []
        for k, e in enumerate(g.d.edges):
            if e.src in ids or e.dst in ids:
                queue.append(k)
                ids |= {e.src, e.dst}
        seen, place = set(queue), {}
        for k, e in enumerate(g.d.edges):
            if e.label:
                place[e.label] = k
        for x in directions:
            for _ in range(depth if x in ("up", "down") else 0):
                if not queue:
                    break
                following = []
                for k in queue:
                    e = g.d.edges[k]
                    others = [place[e.parent]] if x == "up" and e.parent in place else [j for j, c in enumerate(g.d.edges) if e.label and c.parent == e.label] if x == "down" else []
                    for j in others:
                        ids |= {g.d.edges[j].src, g.d.edges[j].dst}
                        if j not in seen:
                            seen.add(j)
                            following.append(j)
                queue = following
    return ids


def subgraph(g, s):
    if s.pred.target == "mixed":
        raise q.QueryError("mixed")
    first = g.first()
    depends = None
    if isinstance(s.pred, q.DependsOn):
        depends = lambda e: e.parent in first and holds(s.pred.inner, "edge", first[e.parent], g.depth)
    edges = [e for e in g.d.edges if holds(s.pred, "edge", e, g.depth, depends)]
    ends = {i for e in edges for i in (e.src, e.dst)}
    if s.pred.target == "edge":
        if not s.directions:
            return Graph(Definition({i: n for i, n in g.d.nodes.items() if i in ends}, edges, g.d.sets))
        return g.induced(walk(g, ends, s.directions, s.depth))
    ids = {i for i, n in g.d.nodes.items() if holds(s.pred, "node", n)}
    if s.pred.target == "" and not ids:
        ids = ends or set(g.d.nodes)
    return g.induced(walk(g, ids, s.directions, s.depth) if s.directions else ids)


def shown(v):
    if v is EMPTY or v == EMPTY:
        return "<nil>"
    if isinstance(v, bool):
        return str(v).lower()
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def collapse(g, s):
    if s.pred.target == "mixed" or s.pred.target == "edge":
        raise q.QueryError("collapse")
    hit = sorted(i for i, n in g.d.nodes.items() if holds(s.pred, "node", n))
    if not hit:
        return g
    attrs = {}
    for i in hit:
        attrs |= g.d.nodes[i].attrs
    nodes = {i: n for i, n in g.d.nodes.items() if i not in hit} | {s.into: NodeRow(s.into, attrs)}
    edges, seen = [], set()
    for e in g.d.edges:
        if e.src in hit and e.dst in hit:
            continue
        e = EdgeRow(s.into if e.src in hit else e.src, s.into if e.dst in hit else e.dst, attrs=e.attrs, sets=e.sets)
        key = (e.src, e.dst, *sorted(f"{k}:{shown(v)}" for k, v in e.attrs.items()))
        if key not in seen:
            seen.add(key)
            edges.append(e)
    return Graph(Definition(nodes, edges, g.d.sets))


def algebra(a, op, b):
    a, b = copy.deepcopy(a.d), copy.deepcopy(b.d)
    ends = lambda d: {(e.src, e.dst) for e in d.edges}
    if op == "+":
        nodes = dict(a.nodes)
        for i, n in b.nodes.items():
            nodes[i] = NodeRow(i, nodes[i].attrs | n.attrs, nodes[i].sets | n.sets, nodes[i].parent) if i in nodes else n
        sets = dict(a.sets)
        for i, s in b.sets.items():
            if i in sets:
                sets[i].attrs |= s.attrs
            else:
                sets[i] = s
        return Graph(Definition(nodes, a.edges + b.edges, sets))
    inside = lambda x, y: {"&": {i: v for i, v in x.items() if i in y}, "-": {i: v for i, v in x.items() if i not in y}, "^": {i: v for i, v in [*x.items(), *y.items()] if (i in x) != (i in y)}}[op]
    nodes = inside(a.nodes, b.nodes)
    edges = [e for e in a.edges if ((e.src, e.dst) in ends(b)) == (op == "&")]
    if op == "^":
        edges += [e for e in b.edges if (e.src, e.dst) not in ends(a)]
    return Graph(Definition(nodes, [e for e in edges if e.src in nodes and e.dst in nodes], inside(a.sets, b.sets)))


def run(start, stages, named=None):
    named = {} if named is None else named
    g = start
    of = lambda name: start if name == "*" else named[name]
    for s in stages:
        g = Graph(g.d)
        if isinstance(s, q.Bind):
            named[s.name] = run(start, s.stages, named)
        elif isinstance(s, q.From):
            g = of(s.name)
        elif isinstance(s, q.Algebra):
            g = algebra(of(s.left), s.op, of(s.right))
        elif isinstance(s, q.Subgraph):
            g = subgraph(g, s)
        elif isinstance(s, q.Collapse):
            g = collapse(g, s)
        elif isinstance(s, q.RemoveOrphans):
            ends = {i for e in g.d.edges for i in (e.src, e.dst)}
            g.d.nodes = {i: n for i, n in g.d.nodes.items() if i in ends}
        elif s.pred.target == "mixed":
            raise q.QueryError("mixed")
        elif isinstance(s, q.RemoveEdges):
            if s.pred.target != "node":
                g.d.edges = [e for e in g.d.edges if not holds(s.pred, "edge", e)]
        elif s.pred.target in ("", s.kind):
            for row in g.d.nodes.values() if s.kind == "node" else g.d.edges:
                if holds(s.pred, s.kind, row):
                    if isinstance(s, q.Make):
                        row.attrs[s.name] = s.value
                    else:
                        row.attrs.pop(s.name, None)
    return g


__all__ = ["Graph", "NodeRef", "run"]

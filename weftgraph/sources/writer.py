"""Canonical text of a graph: sets by id, nodes by first use in an edge, edges in order, children inside their parents.

Elements are ordered by Spark; the text is put together on the driver, as it is one string. lines() and write_text()
are for graphs that don't fit there: the same statements without nesting, a row each, made and written by Spark.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PREFIX, Attributes, Empty, NodeRef, PGraph, no_sets, unpack
from .definition import Definition, EdgeRow, NodeRow, SetRow

_ESCAPED = str.maketrans({'"': '\\"', "\\": "\\\\", "\n": "\\n", "\t": "\\t"})


def collected(graph: PGraph) -> Definition:
    """The graph's rows on the driver, edges in order."""
    graph = graph.in_map("node").in_map("edge")
    attrs = lambda row: {k: unpack(v) for k, v in (row or {}).items()}
    out = Definition()
    for r in graph.nodes.orderBy("id").collect():
        out.nodes[r["id"]] = NodeRow(r["id"], attrs(r["attrs"]), set(r["sets"] or ()), r["parent"])
    for r in graph.edges.orderBy("ord").collect():
        out.edges.append(EdgeRow(r["src"], r["dst"], r["label"], r["parent"], r["scope_depth"], attrs(r["attrs"]), set(r["sets"] or ())))
    for r in graph.sets.orderBy("id").collect():
        out.sets[r["id"]] = SetRow(r["id"], attrs(r["attrs"]), r["declared"])
    return out


def number(x: float) -> str:
    """Digits without an exponent; whole numbers without a fraction."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "+Inf" if x > 0 else "-Inf"
    return format(Decimal(x), "f") if x == int(x) else format(Decimal(repr(x)), "f")


def _attribute(key: str, value: object) -> str:
    if isinstance(value, Empty):
        return key
    if isinstance(value, bool):
        return f"{key}={'true' if value else 'false'}"
    if isinstance(value, NodeRef) or isinstance(value, str) and key == "parent":
        return f"{key}={value}"
    return f'{key}="{value.translate(_ESCAPED)}"' if isinstance(value, str) else f"{key}={number(value)}"


def _attributes(attrs: dict[str, object]) -> str:
    return f" [{', '.join(_attribute(k, attrs[k]) for k in sorted(attrs))}]" if attrs else ""


def _members(sets: set[str]) -> str:
    return "".join(f" @{s}" for s in sorted(sets))


def _block(children: list[str]) -> str:
    return " {\n" + "".join("\n".join("    " + line for line in child.split("\n")) + "\n" for child in children) + "}"


def _in_cycle(start: object, up) -> bool:
    """Whether the chain upwards from start comes back to anything in it."""
    met, at = set(), start
    while at is not None and at not in met:
        met.add(at)
        at = up(at)
    return at is not None


def canonical(graph: PGraph | Definition, keep_parents: bool = False) -> str:
    """The canonical text. keep_parents: an edge whose parent can't be shown by nesting gets it as an attribute, so
    that reading the text again loses nothing; without it, such a parent is left out."""
    rows = graph if isinstance(graph, Definition) else collected(graph)
    parts = ["\n".join("set " + s.id + _attributes(s.attrs) for _, s in sorted(rows.sets.items())), _nodes(rows), _edges(rows, keep_parents)]
    return "\n\n".join(p for p in parts if p)


def _nodes(rows: Definition) -> str:
    place: dict[str, int] = {}
    for k, e in enumerate(rows.edges):
        place.setdefault(e.src, k)
        place.setdefault(e.dst, k)
    order = sorted(rows.nodes, key=lambda i: (place.get(i, len(rows.edges)), i))  # both ends of an edge have its place
    up = lambda i: rows.nodes[i].parent if rows.nodes[i].parent in rows.nodes else None
    below: dict[str, list[str]] = {}
    tops = []
    for i in order:
        if up(i) is None or _in_cycle(i, up):
            tops.append(i)
        else:
            below.setdefault(up(i), []).append(i)

    def text(i: str, nested: bool) -> str:
        row = rows.nodes[i]
        attrs = {k: v for k, v in row.attrs.items() if not (nested and k == "parent")}
        block = _block([text(c, True) for c in below[i]]) if i in below else ""
        return "node " + i + _attributes(attrs) + block + _members(row.sets)

    return "\n".join(text(i, False) for i in tops)


def _edges(rows: Definition, keep_parents: bool) -> str:
    first: dict[str, int] = {}
    for k, e in enumerate(rows.edges):
        if e.label:
            first.setdefault(e.label, k)
    up = lambda k: first.get(rows.edges[k].parent) if rows.edges[k].parent else None
    below: dict[str, list[int]] = {}
    nested = set()
    for k, e in enumerate(rows.edges):
        if up(k) is not None and not _in_cycle(k, up):
            below.setdefault(e.parent, []).append(k)
            nested.add(k)

    def tail(k: int, open_: tuple[str, ...]) -> str:
        e = rows.edges[k]
        attrs = e.attrs | ({"parent": NodeRef(e.parent)} if keep_parents and e.parent and k not in nested else {})
        show = e.label and e.label in below and e.label not in open_
        return _attributes(attrs) + _members(e.sets) + (_block([one(c, (*open_, e.label)) for c in below[e.label]]) if show else "")

    def one(k: int, open_: tuple[str, ...]) -> str:
        e = rows.edges[k]
        return (f"{e.label}: " if e.label else "") + f"{e.src}->{e.dst}" + tail(k, open_)

    lines, groups = [], {}
    for k, e in enumerate(rows.edges):
        if k in nested:
            continue
        if not e.label:
            lines.append(one(k, ()))
        elif e.label in groups:
            groups[e.label].append(k)
        else:
            groups[e.label] = [k]
            lines.append(e.label)  # its place; the text comes when the whole group is known
    shown = {label: _group(rows, members, tail, one) for label, members in groups.items()}
    return "\n".join(shown.get(line, line) for line in lines)


def _group(rows: Definition, members: list[int], tail, one) -> str:
    edges = [rows.edges[k] for k in members]
    if len({e.dst for e in edges}) == 1:
        ends = ",".join(e.src for e in edges) + "->" + edges[0].dst
    elif len({e.src for e in edges}) == 1:
        ends = edges[0].src + "->" + ",".join(e.dst for e in edges)
    else:
        return "\n".join(one(k, ()) for k in members)
    return f"{edges[0].label}: {ends}" + tail(members[0], ())


# ---- statements as rows -----------------------------------------------------------------------------------


def _digits(n: Column) -> Column:
    """A number without an exponent, as number() gives it for up to 38 digits, 18 of them behind the point."""
    shown = n.cast("string")
    plain = F.when(F.contains(shown, F.lit("E")), F.regexp_replace(n.try_cast("decimal(38,18)").cast("string"), "0+$", "")).otherwise(shown)
    return F.coalesce(F.when(n == F.rint(n), n.try_cast("decimal(38,0)").cast("string")).otherwise(plain), shown)


def _assigned(key: Column, value: Column) -> Column:
    """key=value as attributes are written."""
    text = value["s"]
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    bare = (value["t"] == "r") | (key == "parent")
    shown = F.when(value["t"] == "b", value["b"].cast("string")).when(value["t"] == "n", _digits(value["n"])).when(bare, value["s"]).otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    return F.when(value["t"] == "e", key).otherwise(F.concat(key, F.lit("="), shown))


def _statement(columns: dict[str, str], start: Column, more: list[Column], grouped: bool = True) -> Column:
    """start, the attributes by name, and memberships; more: further attributes as structs of k and v, null if absent."""
    of = Attributes(columns)
    entry = lambda k, v: F.struct(k.alias("k"), _assigned(k, v).alias("v"))
    shredded = [F.when(F.col(f"`{PREFIX}{n}`").isNotNull(), entry(F.lit(n), of.value(n))) for n in columns]
    found = F.transform(F.coalesce(F.map_entries("attrs"), F.array().cast("array<struct<key:string,value:struct<t:string,s:string,n:double,b:boolean>>>")), lambda e: entry(e["key"], e["value"]))
    found = F.array_sort(F.filter(F.concat(found, F.array(*shredded, *more)) if shredded or more else found, lambda x: x.isNotNull()))
    attrs = F.when(F.size(found) > 0, F.concat(F.lit(" ["), F.array_join(found["v"], ", "), F.lit("]"))).otherwise("")
    members = F.array_join(F.transform(F.array_sort(F.coalesce("sets", no_sets())), lambda s: F.concat(F.lit(" @"), s)), "") if grouped else F.lit("")
    return F.concat(start, attrs, members)


def lines(graph: PGraph) -> DataFrame:
    """part (0 set, 1 node, 2 edge), id (of sets and nodes), ord (of edges), line: a statement for each element. Read in
    this order they give the graph again, but for the depths of scopes, as blocks become attributes `parent`."""
    none = F.lit(None)
    parent = F.when(F.col("parent") != "", F.struct(F.lit("parent").alias("k"), F.concat(F.lit("parent="), F.col("parent")).alias("v")))
    sets = graph.sets.select(F.lit(0).alias("part"), "id", none.cast("long").alias("ord"), _statement({}, F.concat(F.lit("set "), F.col("id")), [], False).alias("line"))
    nodes = graph.nodes.select(F.lit(1), "id", none.cast("long"), _statement(graph.node_columns, F.concat(F.lit("node "), F.col("id")), []))
    each = graph.edges.select("ord", "src", "dst", "label", _statement(graph.edge_columns, F.lit(""), [parent]).alias("rest"))
    # A label stands once: its edges are one statement if they share an end.
    held = each.filter("label <> ''").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("ord", "src", "dst", "rest"))).alias("all"))
    ends = lambda e: F.array_join(F.col("all")[e], ",")
    of = lambda x, src, dst: F.struct(x["ord"].alias("ord"), F.concat("label", F.lit(": "), src, F.lit("->"), dst, x["rest"]).alias("line"))
    first = F.col("all")[0]
    written = F.when(F.size(F.array_distinct(F.col("all")["dst"])) == 1, F.array(of(first, ends("src"), first["dst"]))).when(F.size(F.array_distinct(F.col("all")["src"])) == 1, F.array(of(first, first["src"], ends("dst"))))
    labelled = held.select(F.explode(written.otherwise(F.transform("all", lambda x: of(x, x["src"], x["dst"])))).alias("e")).select("e.ord", "e.line")
    edges = each.filter("label = ''").select("ord", F.concat("src", F.lit("->"), "dst", "rest").alias("line")).unionByName(labelled).select(F.lit(2), none.cast("string"), "ord", "line")
    return sets.union(nodes).union(edges)


def write_text(graph: PGraph, path: str) -> None:
    """The lines of a graph as text files in order: read one after another by name, they are its definition."""
    lines(graph).orderBy("part", "id", "ord").select("line").write.text(path)

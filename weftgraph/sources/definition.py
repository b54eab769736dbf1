"""Graph definition text: reading it into rows, and rows into a graph.

    node a [key="v", n=1, flag, parent=b]: or  node a: "text"   { nested nodes } @set
    set s [key="v"]
    label: a,b -> c [key="v"]: "text" @set { statements }
    # comment

Text is read on the driver, as one file is one graph and its statements depend on those before. Many files are read
by Spark, one graph per file (read_files), or as the statements of one graph (read_graph).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.lineage import cut
from ..functions.workers import ship
from ..model import EDGES, EMPTY, GROUPS, NODES, NodeRef, PGraph, merged, no_attrs, pack

#: The tokens of the language.
_TOKENS = re.compile(r'(?P<space>[ \t\r\n]+)|(?P<comment>#[^\n]*)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<number>[0-9]+(?:\.[0-9]*)?)|(?P<id>[A-Za-z_][A-Za-z0-9_]*)|(?P<arrow>->)|(?P<mark>[\[\]{},:=@])', re.DOTALL)
_RESERVED = {"node", "set", "true", "false"}
_ESCAPES = {'"': '"', "\\": "\\", "n": "\n", "t": "\t"}


class DefinitionError(ValueError):
    """Text that isn't a graph definition."""


@dataclass
class NodeRow:
    id: str
    attrs: dict[str, object] = field(default_factory=dict)
    sets: set[str] = field(default_factory=set)
    parent: str | None = None


@dataclass
class EdgeRow:
    src: str
    dst: str
    label: str = ""
    parent: str = ""
    scope_depth: int = 0
    attrs: dict[str, object] = field(default_factory=dict)
    sets: set[str] = field(default_factory=set)


@dataclass
class SetRow:
    id: str
    attrs: dict[str, object] = field(default_factory=dict)
    declared: bool = True


@dataclass
class Definition:
    """A graph as Python rows; edges in order."""

    nodes: dict[str, NodeRow] = field(default_factory=dict)
    edges: list[EdgeRow] = field(default_factory=list)
    sets: dict[str, SetRow] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    # -- building by hand: an id that is there already is returned as it is; edges need both ends

    def add_node(self, node_id: str, attrs: dict[str, object] | None = None) -> NodeRow:
        if node_id not in self.nodes:
            parent = (attrs or {}).get("parent")
            self.nodes[node_id] = NodeRow(node_id, dict(attrs or {}), parent=str(parent) if isinstance(parent, NodeRef) else None)
        return self.nodes[node_id]

    def add_set(self, set_id: str, attrs: dict[str, object] | None = None) -> SetRow:
        return self.sets.setdefault(set_id, SetRow(set_id, dict(attrs or {})))

    def add_edge(self, src: str, dst: str, attrs: dict[str, object] | None = None, label: str = "", parent: str = "") -> EdgeRow:
        for end in (src, dst):
            if end not in self.nodes:
                raise DefinitionError(f"no node {end!r}")
        self.edges.append(EdgeRow(src, dst, label, parent, attrs=dict(attrs or {})))
        return self.edges[-1]

    def remove_node(self, node_id: str) -> None:
        if node_id not in self.nodes:
            raise DefinitionError(f"no node {node_id!r}")
        if any(node_id in (e.src, e.dst) for e in self.edges):
            raise DefinitionError(f"node {node_id!r} has edges")
        del self.nodes[node_id]

    def remove_edge(self, src: str, dst: str) -> None:
        """Removes the first edge from src to dst."""
        for k, e in enumerate(self.edges):
            if (e.src, e.dst) == (src, dst):
                del self.edges[k]
                return
        raise DefinitionError(f"no edge {src!r} -> {dst!r}")

    def children(self) -> dict[int, list[int]]:
        """For the place of each edge with a label, the first one to have it, the places of the edges that depend on it."""
        first: dict[str, int] = {}
        for k, e in enumerate(self.edges):
            if e.label:
                first.setdefault(e.label, k)
        out: dict[int, list[int]] = {}
        for k, e in enumerate(self.edges):
            if e.parent in first:
                out.setdefault(first[e.parent], []).append(k)
        return out

    def rows(self) -> tuple[list, list, list]:
        packed = lambda attrs: {k: pack(v) for k, v in attrs.items()}
        nodes = [(n.id, packed(n.attrs), sorted(n.sets), n.parent) for n in self.nodes.values()]
        edges = [(k, e.src, e.dst, e.label, e.parent, e.scope_depth, packed(e.attrs), sorted(e.sets)) for k, e in enumerate(self.edges)]
        return nodes, edges, [(s.id, packed(s.attrs), s.declared) for s in self.sets.values()]

    def graph(self, spark: SparkSession) -> PGraph:
        nodes, edges, sets = self.rows()
        return PGraph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(sets, GROUPS))


class _Parser:
    """Reads statements and applies them one after another."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str, int]] = []
        at, line = 0, 1
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise DefinitionError(f"line {line}: unexpected {text[at]!r}")
            if m.lastgroup not in ("space", "comment"):
                self.tokens.append((m.lastgroup, m.group(), line))
            line += m.group().count("\n")
            at = m.end()
        self.at = 0
        self.out = Definition()
        #: Labels of the open blocks, from the outermost on, and the label each block depends on.
        self.scopes: list[tuple[set[str], str]] = [(set(), "")]

    # -- tokens

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        k = self.at + ahead
        return self.tokens[k][:2] if k < len(self.tokens) else ("end", "")

    def fail(self, what: str) -> DefinitionError:
        line = self.tokens[min(self.at, len(self.tokens) - 1)][2] if self.tokens else 1
        return DefinitionError(f"line {line}: {what}")

    def take(self, text: str) -> bool:
        kind, found = self.peek()
        if found == text and kind in ("mark", "arrow", "id"):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise self.fail(f"expected {text!r}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, text = self.peek()
        if kind != "id" or text in _RESERVED:
            raise self.fail(f"expected a name, found {text!r}")
        self.at += 1
        return text

    def string(self) -> str:
        kind, text = self.peek()
        if kind != "string":
            raise self.fail(f"expected a string, found {text!r}")
        self.at += 1
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1], flags=re.DOTALL)

    # -- parts of statements

    def attributes(self, of: str) -> dict[str, object]:
        found: dict[str, object] = {}
        if not self.take("["):
            return found
        if self.take("]"):
            return found
        while True:
            key = self.name()
            if key in found:
                raise self.fail(f"attribute {key!r} stands twice")
            if key == "parent" and of != "node":
                self.need("=")
                found[key] = self.name()
            else:
                found[key] = self.value(of) if self.take("=") else EMPTY
            if not self.take(","):
                break
        self.need("]")
        return found

    def value(self, of: str) -> object:
        kind, text = self.peek()
        if kind == "string":
            return self.string()
        if kind == "number":
            self.at += 1
            return float(text)
        if kind == "id" and text in ("true", "false"):
            self.at += 1
            return text == "true"
        name = self.name()
        if of != "node":
            raise self.fail(f"{name!r} refers to a node, which only attributes of nodes may do")
        return NodeRef(name)

    def members(self) -> list[str]:
        found = []
        while self.take("@"):
            found.append(self.name())
        return found

    def names(self) -> list[str]:
        found = [self.name()]
        while self.take(","):
            found.append(self.name())
        return found

    # -- statements

    def read(self, whole: bool = True) -> Definition:
        """whole: labels that edges depend on must be there."""
        while self.peek()[0] != "end":
            self.statement(False)
        if not whole:
            return self.out
        known = {e.label for e in self.out.edges if e.label}
        for e in self.out.edges:
            if e.parent and e.parent not in known:
                raise DefinitionError(f"edge {e.src}->{e.dst} depends on the unknown label {e.parent!r}")
        return self.out

    def statement(self, inside: bool) -> None:
        if self.take("node"):
            self.node(None)
        elif self.take("set"):
            self.group()
        else:
            self.edge(inside)

    def node(self, enclosing: str | None) -> None:
        name = self.name()
        attrs = self.attributes("node")
        if not attrs and self.take(":"):
            attrs = {"text": self.string()}
        row = self.out.nodes.setdefault(name, NodeRow(name))
        row.attrs |= attrs
        if enclosing is not None:
            if "parent" in row.attrs:
                self.out.warnings.append(f"node {name!r} has a parent other than by its block")
            else:
                row.attrs["parent"] = NodeRef(enclosing)
        if isinstance(row.attrs.get("parent"), NodeRef):
            row.parent = str(row.attrs["parent"])
        # A block's nodes come after the node itself, but its memberships stand behind the block.
        block = self.at
        if self.take("{"):
            self.skip_block()
        row.sets |= self.joined(self.members())
        after, self.at = self.at, block
        if name in self.out.sets:
            self.out.warnings.append(f"{name!r} is a node and a set")
        if self.take("{"):
            while not self.take("}"):
                self.need("node")
                self.node(name)
        self.at = after

    def skip_block(self) -> None:
        depth = 1
        while depth:
            kind, text = self.peek()
            if kind == "end":
                raise self.fail("a block isn't closed")
            depth += (kind == "mark") * ((text == "{") - (text == "}"))
            self.at += 1

    def joined(self, sets: list[str]) -> set[str]:
        for name in sets:
            if name not in self.out.sets:
                self.out.sets[name] = SetRow(name, declared=False)
                self.out.warnings.append(f"set {name!r} isn't declared")
        return set(sets)

    def group(self) -> None:
        name = self.name()
        attrs = self.attributes("set")
        row = self.out.sets.setdefault(name, SetRow(name))
        row.declared = True
        row.attrs |= attrs
        if name in self.out.nodes:
            self.out.warnings.append(f"{name!r} is a node and a set")

    def edge(self, inside: bool) -> None:
        label = ""
        if self.peek()[0] == "id" and self.peek(1)[1] == ":":
            label = self.name()
            self.need(":")
        left = self.names()
        self.need("->")
        right = self.names()
        if len(left) > 1 and len(right) > 1:
            raise self.fail("several nodes on both sides of an edge")
        attrs = self.attributes("edge")
        text = {"text": self.string()} if self.take(":") else {}
        members = self.members()
        if label and any(label in labels for labels, _ in self.scopes):
            raise self.fail(f"label {label!r} stands twice")
        if inside and "parent" in attrs:
            raise self.fail("an edge inside a block depends on the block's edge")
        parent = attrs.pop("parent", "")
        above = self.scopes[-1][1]
        joined = self.joined(members)
        for src in left:
            for dst in right:
                for end in (src, dst):
                    self.out.nodes.setdefault(end, NodeRow(end))
                depends = above if inside and above else str(parent)
                self.out.edges.append(EdgeRow(src, dst, label, depends, len(self.scopes) - 1, text | attrs, set(joined)))
        if label:
            self.scopes[-1][0].add(label)
        if self.take("{"):
            self.scopes.append((set(), label))
            while not self.take("}"):
                if self.peek()[0] == "end":
                    raise self.fail("a block isn't closed")
                self.statement(True)
            self.scopes.pop()


def parse(text: str) -> Definition:
    """The graph that a text defines; its warnings stand in the result, errors are raised."""
    return _Parser(text).read()


def read_file(spark: SparkSession, path: str) -> PGraph:
    """The graph of one file, read by Spark, from wherever Spark can read."""
    return parse(spark.read.text(path, wholetext=True).first()["value"]).graph(spark)


FILE_ROWS = T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("error", T.StringType()), *(T.StructField(k, s) for k, s in (("node", NODES), ("edge", EDGES), ("group", GROUPS)))])


def read_files(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Many files at once: path, kind (node, edge, set or error), and the row of that kind; each file is its own graph.

    whole=False: an edge may depend on a label of another file."""
    ship(spark)
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))

    def rows(partition) -> Iterator[tuple]:
        for path, text in partition:
            try:
                nodes, edges, sets = _Parser(text).read(whole).rows()
            except DefinitionError as wrong:
                yield path, "error", str(wrong), None, None, None
                continue
            yield from ((path, "node", None, n, None, None) for n in nodes)
            yield from ((path, "edge", None, None, e, None) for e in edges)
            yield from ((path, "set", None, None, None, s) for s in sets)

    # Rows of three nested kinds come out of one text each: there is no batch to gain from Arrow here.
    return spark.createDataFrame(texts.rdd.mapPartitions(rows), FILE_ROWS)


def read_graph(spark: SparkSession, path: str) -> PGraph:
    """One graph from many files, as if their texts stood one after another by path: of an attribute the last value
    counts, memberships add up, edges keep their order. A file that can't be read, a label of edges outside blocks that
    two files use, and a dependency on a label that no file has are errors."""
    rows = cut(read_files(spark, path, whole=False), "files")
    if wrong := rows.filter("kind = 'error'").orderBy("path").first():
        raise DefinitionError(f"{wrong['path']}: {wrong['error']}")
    edges = rows.filter("kind = 'edge'").select("path", "edge.*")
    top = edges.filter("label <> '' AND scope_depth = 0")
    if twice := top.groupBy("label").agg(F.min("path").alias("lo"), F.max("path").alias("hi")).filter("lo <> hi").first():
        raise DefinitionError(f"label {twice['label']!r} stands twice, in {twice['lo']} and {twice['hi']}")
    if lost := edges.filter("parent <> ''").join(edges.filter("label <> ''").select(F.col("label").alias("parent")), "parent", "left_anti").first():
        raise DefinitionError(f"edge {lost['src']}->{lost['dst']} depends on the unknown label {lost['parent']!r}")
    # One row a file is numbered; its edges come after those of the files before.
    sizes = edges.groupBy("path").agg(F.count("*").alias("n"))
    before = sizes.select("path", F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    edges = edges.join(before, "path").withColumn("ord", F.col("ord") + F.col("before")).select(*EDGES.names)

    def folded(kind: str, *more: Column) -> DataFrame:
        found = rows.filter(F.col("kind") == kind).select("path", "node.*" if kind == "node" else "group.*")
        each = F.sort_array(F.collect_list(F.struct("path", F.map_entries("attrs").alias("entries"))))
        return found.groupBy("id").agg(F.aggregate(each, no_attrs(), lambda held, x: merged(held, F.map_from_entries(x["entries"]))).alias("attrs"), *more)

    nodes = folded("node", F.array_sort(F.array_distinct(F.flatten(F.collect_list("sets")))).alias("sets"))
    parent = F.col("attrs").getItem("parent")
    return PGraph(nodes.withColumn("parent", F.when(parent["t"] == "r", parent["s"])).select(*NODES.names), edges, folded("set", F.max("declared").alias("declared")).select(*GROUPS.names))

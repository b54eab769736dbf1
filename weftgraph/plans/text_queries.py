'''Registered queries over a small graph held in code: definition text, its canonical form, diagrams, refusals, changes.

What each must give stands beside it, written out by hand, and goes to SQL as VALUES.
'''

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGES, NODES, PGraph
from ..operators import mutate
from ..sources.definition import parse
from ..sources.diagrams import render
from ..sources.writer import canonical, lines, number
from .query_text import ALL_EDGES, ALL_NODES, QueryError, Subgraph
from .session import Context, execute, query, run

TEXT = """# parts of a service
set core [tier=1]
node web [team="front", port=80, live] @core
node api: "Public API" {
  node auth [parent=web]
  node data [ready=true]
}
CALLS: web->api,auth [protocol="http"]: "asks" @core @extra {
  api->data [retries=3]
  data->store
}
store->web [parent=CALLS, arrow="return"]: "rows"
"""

CANONICAL = """set core [tier=1]
set extra

node api [text="Public API"] {
    node data [ready=true]
}
node web [live, port=80, team="front"] {
    node auth
} @core
node store

CALLS: web->api,auth [protocol="http", text="asks"] @core @extra {
    api->data [retries=3]
    data->store
    store->web [arrow="return", text="rows"]
}"""

LINES = """set core [tier=1]
set extra
node api [text="Public API"]
node auth [parent=web]
node data [parent=api, ready=true]
node store
node web [live, port=80, team="front"] @core
CALLS: web->api,auth [protocol="http", text="asks"] @core @extra
api->data [parent=CALLS, retries=3]
data->store [parent=CALLS]
store->web [arrow="return", parent=CALLS, text="rows"]"""

_ARROWS = """  web --> api
  web --> auth
  api --> data
  data --> store
  store --> web
"""

DIAGRAMS = {
    ("mermaid", "component"): """graph TB
  subgraph api["Public API"]
    data["data"]
  end
  subgraph web["web"]
    auth["auth"]
  end
  store["store"]

""" + _ARROWS,
    ("mermaid", "graph"): """graph TD
  api["Public API"]
  auth["auth"]
  data["data"]
  store["store"]
  web["web"]

""" + _ARROWS,
    ("mermaid", "sequence"): """sequenceDiagram
    participant web
    participant api as Public API
    participant auth
    participant data
    participant store
    web ->>+ api: asks
        api ->> data:
        data ->> store:
        store -->> web: rows
    deactivate api
    web ->>+ auth: asks
    deactivate auth
""",
    ("plantuml", "component"): """@startuml

package "Public API" as api {
  component data
}
package "web" as web {
  component auth
}
component store

""" + _ARROWS.replace("  ", "") + """
@enduml
""",
    ("plantuml", "sequence"): """@startuml

participant web
participant api as "Public API"
participant auth
participant data
participant store

web -> api ++: asks
    api -> data
    data -> store
    store --> web: rows
return

web -> auth ++: asks
return

@enduml
""",
}

#: Queries, and whether they are refused.
REFUSALS = [
    ("", False), ("subgraph node.port = 80", False), ("subgraph exists traverse both up all", False), ("subgraph node.team = x AND edge.protocol = y", True), ("collapse into X where edge.protocol = http", True),
    ("from NONE", True), ("NONE + *", True), ("(from *) as A | (from *) as A", True), ("subgraph exists traverse in 0", True), ("subgraph edge.depth = 1.5", True), ("subgraph in core OR in extra", True), ("make node.x = 1", True),
]

Rows = list[tuple]


def _small(spark: SparkSession) -> PGraph:
    return parse(TEXT).graph(spark)


def _numbered(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"))), "n int, line string")


def _nodes(spark: SparkSession) -> DataFrame:
    each = _small(spark).nodes.select("id", "parent", F.explode_outer("attrs").alias("key", "v"))
    value = F.coalesce(F.col("v.s"), F.col("v.n").cast("int").cast("string"), F.col("v.b").cast("string"))
    return each.select("id", "key", F.col("v.t").alias("tag"), value.alias("value"), "parent")


def _edges(spark: SparkSession) -> DataFrame:
    g = _small(spark)
    return g.edges.select(F.col("ord").cast("int"), "src", "dst", "label", "parent", "scope_depth", F.array_join(F.array_sort("sets"), ",").alias("members"), F.array_join(F.array_sort(F.map_keys("attrs")), ",").alias("keys"))


def _sets(spark: SparkSession) -> DataFrame:
    return _small(spark).sets.select("id", "declared", F.col("attrs").getItem("tier")["n"].cast("int").alias("tier"))


def _children(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, j) for k, js in parse(TEXT).children().items() for j in js], "edge int, child int")


def _refused(spark: SparkSession) -> DataFrame:
    def refused(text: str) -> bool:
        try:
            query(_small(spark), text)
        except QueryError:
            return True
        return False

    return spark.createDataFrame([(text, refused(text)) for text, _ in REFUSALS], "query string, refused boolean")


def _algebra_sets(spark: SparkSession) -> DataFrame:
    context = Context(parse("set a\nset b\nnode x").graph(spark))
    context.named["B"] = parse("set b\nset c\nnode y").graph(spark)
    found = [run(context, f"* {op} B").sets.select(F.lit(op).alias("op"), "id") for op in "+&-^"]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def _all_of_a_kind(spark: SparkSession) -> DataFrame:
    """What the predicates on all nodes and on all edges select; the language can't say them."""
    g = parse("node alone\na->b\nb->b").graph(spark)
    found = [(name, execute(Context(g), (Subgraph(pred),))) for name, pred in (("nodes", ALL_NODES), ("edges", ALL_EDGES))]
    return spark.createDataFrame([(name, r["id"]) for name, x in found for r in x.nodes.collect()], "pred string, id string")


def _mutated(spark: SparkSession) -> DataFrame:
    """Elements after single changes, as lines."""
    g = parse("node a [k=1]\na->b\na->b [second]").graph(spark)
    rows = lambda *ids: spark.createDataFrame([(i, {"k": ("s", "new", None, None)}, [], None) for i in ids], NODES)
    edge = lambda src, dst: spark.createDataFrame([(0, src, dst, "", "", 0, {}, [])], EDGES)
    done = {
        "add_nodes": mutate.add_nodes(g, rows("a", "c")), "put_nodes": mutate.put_nodes(g, rows("a", "c")), "add_edges": mutate.add_edges(g, edge("b", "a")),
        "put_edges": mutate.put_edges(g, edge("x", "y")), "remove_edge": mutate.remove_edge(g, "a", "b"), "remove_node": mutate.remove_node(mutate.add_nodes(g, rows("c")), "c"), "with_state": mutate.with_state(g, nodes=rows("z")),
    }
    each = [lines(x).select(F.lit(name).alias("change"), "line") for name, x in done.items()]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


_A, _B, _E, _E2 = "node a [k=1]", "node b", "a->b", "a->b [second]"

#: name: (query, columns with SQL types, the rows it must give)
_ALL: dict[str, tuple[Callable[[SparkSession], DataFrame], str, Rows]] = {
    "source_nodes": (_nodes, "id VARCHAR, key VARCHAR, tag VARCHAR, value VARCHAR, parent VARCHAR", [
        ("web", "team", "s", "front", None), ("web", "port", "n", "80", None), ("web", "live", "e", None, None), ("api", "text", "s", "Public API", None), ("auth", "parent", "r", "web", "web"),
        ("data", "ready", "b", "true", "api"), ("data", "parent", "r", "api", "api"), ("store", None, None, None, None),
    ]),
    "source_edges": (_edges, "ord INT, src VARCHAR, dst VARCHAR, label VARCHAR, parent VARCHAR, scope_depth INT, members VARCHAR, keys VARCHAR", [
        (0, "web", "api", "CALLS", "", 0, "core,extra", "protocol,text"), (1, "web", "auth", "CALLS", "", 0, "core,extra", "protocol,text"), (2, "api", "data", "", "CALLS", 1, "", "retries"),
        (3, "data", "store", "", "CALLS", 1, "", ""), (4, "store", "web", "", "CALLS", 0, "", "arrow,text"),
    ]),
    "source_sets": (_sets, "id VARCHAR, declared BOOLEAN, tier INT", [("core", True, 1), ("extra", False, None)]),
    "source_warnings": (lambda spark: spark.createDataFrame([(w,) for w in parse(TEXT).warnings], "warning string"), "warning VARCHAR", [("node 'auth' has a parent other than by its block",), ("set 'extra' isn't declared",)]),
    "source_children": (_children, "edge INT, child INT", [(0, 2), (0, 3), (0, 4)]),
    "source_canonical": (lambda spark: _numbered(spark, canonical(_small(spark))), "n INT, line VARCHAR", list(enumerate(CANONICAL.split("\n")))),
    "source_canonical_again": (lambda spark: _numbered(spark, canonical(parse(canonical(_small(spark))).graph(spark))), "n INT, line VARCHAR", list(enumerate(CANONICAL.split("\n")))),
    "source_ties": (lambda spark: _numbered(spark, canonical(parse("node z\nnode y\nb->a").graph(spark))), "n INT, line VARCHAR", list(enumerate(["node a", "node b", "node y", "node z", "", "b->a"]))),
    "source_numbers": (lambda spark: spark.createDataFrame([(number(x),) for x in (5.0, 0.5, 1e21, 1e-7, 123456789.25)], "shown string"), "shown VARCHAR", [("5",), ("0.5",), ("1000000000000000000000",), ("0.0000001",), ("123456789.25",)]),
    "source_lines": (lambda spark: lines(_small(spark)).select("line"), "line VARCHAR", [(x,) for x in LINES.split("\n")]),
    **{f"diagram_{language}_{kind}": (lambda spark, of=(language, kind): _numbered(spark, render(_small(spark), *of)), "n INT, line VARCHAR", list(enumerate(text.rstrip("\n").split("\n")))) for (language, kind), text in DIAGRAMS.items()},
    "refusals": (_refused, "query VARCHAR, refused BOOLEAN", REFUSALS),
    "algebra_sets": (_algebra_sets, "op VARCHAR, id VARCHAR", [("+", "a"), ("+", "b"), ("+", "c"), ("&", "b"), ("-", "a"), ("^", "a"), ("^", "c")]),
    "all_of_a_kind": (_all_of_a_kind, "pred VARCHAR, id VARCHAR", [("nodes", "alone"), ("nodes", "a"), ("nodes", "b"), ("edges", "a"), ("edges", "b")]),
    "mutations": (_mutated, "change VARCHAR, line VARCHAR", [
        *(("add_nodes", x) for x in (_A, _B, 'node c [k="new"]', _E, _E2)), *(("put_nodes", x) for x in ('node a [k="new"]', _B, 'node c [k="new"]', _E, _E2)), *(("add_edges", x) for x in (_A, _B, _E, _E2, "b->a")),
        *(("put_edges", x) for x in (_A, _B, _E, _E2, "x->y")), *(("remove_edge", x) for x in (_A, _B, _E2)), *(("remove_node", x) for x in (_A, _B, _E, _E2)), *(("with_state", x) for x in ('node z [k="new"]', _E, _E2)),
    ]),
}


def _sql(columns: str, rows: Rows) -> str:
    def literal(x: object, kind: str) -> str:
        shown = "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
        return f"CAST({shown} AS {kind})"

    named = [c.split(" ") for c in columns.split(", ")]
    values = ", ".join("(" + ", ".join(literal(x, kind) for x, (_, kind) in zip(row, named)) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {values}) v({', '.join(name for name, _ in named)})"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, make=make: make(spark)) for name, (make, _, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _sql(columns, rows) for name, (_, columns, rows) in _ALL.items()}

"""Walks, scopes and contractions over the whole containment graph, against the plain engine on small tables."""

import plain_engine
import pytest

import __spark_entry__ as entry
from weftgraph.model import PGraph
from weftgraph.plans import query_text
from weftgraph.plans.table_graphs import containment
from weftgraph.sources.definition import Definition, EdgeRow, NodeRow

FROM = "/root/testdata/sf0.001"
QUERIES = {
    "traverse_up_1": ("subgraph node.id == o_7 traverse up 1", "edge", ["rel"]),
    "traverse_up_all": ("subgraph node.id == o_7 traverse up all", "node", ["kind"]),
    "traverse_down_1": ("subgraph node.id == n_3 traverse down 1", "node", ["kind"]),
    "scope_all": ("subgraph edge.rel == region scope", "node", ["kind"]),
    "collapse_segment": ('collapse into B where node.segment == "BUILDING"', "edge", ["rel", "returnflag", "quantity"]),
    "collapse_nodes": ('collapse into B where node.segment == "BUILDING"', "node", ["kind", "name"]),
}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A few customers with their orders and line items, order 7 and nation 3 among them."""
    folder = str(tmp_path_factory.mktemp("small"))
    read = lambda name: spark.read.parquet(f"{FROM}/{name}.parquet")
    orders = read("orders").filter("o_orderkey <= 40")
    items = read("lineitem").filter("l_orderkey <= 40")
    for name, df in {"region": read("region"), "nation": read("nation"), "customer": read("customer"), "orders": orders, "lineitem": items, "part": read("part")}.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


def plain(graph: PGraph) -> plain_engine.Graph:
    node_names, edge_names = list(graph.columns_of("node")), list(graph.columns_of("edge"))
    held = lambda r, names: {n: r[n] for n in names if r[n] is not None}
    nodes = {r["id"]: NodeRow(r["id"], held(r, node_names)) for r in graph.flat("node", node_names).collect()}
    found = graph.edges.select("ord", "src", "dst", "label", "parent", *(f"a_{n}" for n in edge_names)).orderBy("ord").collect()
    edges = [EdgeRow(r["src"], r["dst"], label=r["label"], parent=r["parent"], attrs={n: r[f"a_{n}"] for n in edge_names if r[f"a_{n}"] is not None}) for r in found]
    return plain_engine.Graph(Definition(nodes, edges, {}))


@pytest.mark.parametrize("name", QUERIES)
def test_whole_graph(spark, small, name):
    text, kind, names = QUERIES[name]
    want = plain_engine.run(plain(containment(spark, small)), query_text.parse(text)).d
    got = entry.queries()[name](spark, small)
    if kind == "node":
        rows = [(n.id, *(n.attrs.get(x) for x in names)) for n in want.nodes.values()]
        got = got.select("id", *names)
    else:
        rows = [(e.src, e.dst, e.label or "", e.parent or "", *(e.attrs.get(x) for x in names)) for e in want.edges]
    found = [tuple(None if v is None else str(v) for v in r) for r in got.collect()]
    assert sorted(found, key=repr) == sorted((tuple(None if v is None else str(v) for v in r) for r in rows), key=repr)
    if kind == "node":
        assert any(r[1] == "part" for r in rows)
    elif kind == "edge":
        assert any("order" in r for r in rows)

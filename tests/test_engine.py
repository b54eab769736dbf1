"""The Spark engine against the plain one, on graphs and queries drawn at random, and on cases written out."""

import os
import random

import pytest

import plain_engine
from weftgraph.functions import lineage
from weftgraph.model import NodeRef, from_tables
from weftgraph.plans import query_text as q
from weftgraph.plans.session import Context, query, run
from weftgraph.sources.definition import Definition, EdgeRow, NodeRow, SetRow, parse
from weftgraph.sources.writer import canonical


def drawn_graph(rng):
    ids = "abcdefgh"
    value = lambda: rng.choice(["x", "y", 1.0, True, False, "1"])
    attrs = lambda: {k: value() for k in "pq" if rng.random() < 0.5}
    sets = lambda: {s for s in ("s", "t") if rng.random() < 0.3}
    labels = ["L1", "L2", "L3", "L3"]
    nodes = {i: NodeRow(i, attrs(), sets()) for i in ids}
    edges = [EdgeRow(rng.choice(ids), rng.choice(ids), rng.choice(["", "", *labels]), rng.choice(["", "", *labels, "gone"]), 0, attrs(), sets()) for _ in range(rng.randint(0, 14))]
    return Definition(nodes, edges, {s: SetRow(s) for s in ("s", "t")})


def drawn_pred(rng, deep=0):
    kind = rng.choice(["node", "edge"])
    forms = [
        f"{kind}.{rng.choice('pq')} {rng.choice(['=', '==', '!='])} {rng.choice(['x', '1', 'true'])}", f"{kind}.{rng.choice('pq')} {rng.choice(['exists', 'not exists'])}", f"{kind} {rng.choice(['in', 'not in'])} @{rng.choice(['s', 't', 'u'])}",
        "exists", rng.choice(["in s", "not in t", "in u"]), f"node.id {rng.choice(['=', '!='])} {rng.choice('abz')}", f"edge parent {rng.choice(['exists', 'not exists'])}", f"edge.depth {rng.choice(['=', '!='])} {rng.randint(0, 3)}", "not exists",
    ]
    if deep < 2 and rng.random() < 0.35:
        return rng.choice([f"{drawn_pred(rng, 2)} AND {drawn_pred(rng, 2)}", f"not {drawn_pred(rng, 2)}", f"edge depends on {drawn_pred(rng, 2)}"])
    return rng.choice(forms)


def drawn_stage(rng):
    pred = drawn_pred(rng)
    walk = rng.choice(["", "", " scope", f" traverse {' '.join(rng.choices(['in', 'out', 'both', 'up', 'down'], k=rng.randint(1, 2)))} {rng.choice(['1', '2', 'all'])}"])
    return rng.choice([
        f"subgraph {pred}{walk}", f"subgraph {pred}{walk}", f"make {rng.choice(['node', 'edge'])}.{rng.choice('pr')} = {rng.choice(['x', '5', 'true'])} where {pred}", f"remove edge where {pred}",
        f"remove {rng.choice(['node', 'edge'])}.{rng.choice('pq')} where {pred}", "remove orphans", f"collapse into {rng.choice('ahZ')} where {pred}", f"({drawn_stage(rng) if rng.random() < 0.3 else f'subgraph {pred}'}) as G | G {rng.choice('+&-^')} *", f"(subgraph {pred}) as G | * {rng.choice('+&-^')} G",
    ])


def outcome(make):
    try:
        return canonical(make(), keep_parents=True)
    except q.QueryError:
        return "error"


@pytest.mark.parametrize("seed", range(200) if os.environ.get("WEFT_CASES") else range(40))
def test_as_the_plain_engine(spark, seed):
    rng = random.Random(seed)
    graph = drawn_graph(rng)
    text = " | ".join(drawn_stage(rng) for _ in range(rng.randint(1, 2)))
    if text.count("as G") > 1:
        text = text.replace("as G", "as H", 1)
    want = outcome(lambda: plain_engine.run(plain_engine.Graph(graph), q.parse(text)).d)
    assert outcome(lambda: query(graph.graph(spark), text)) == want, text


def shredded(spark):
    nodes = spark.createDataFrame([("a", "x", 1.0, None), ("b", "y", None, True), ("c", None, 2.0, False)], "id string, p string, n double, f boolean")
    edges = spark.createDataFrame([(0, "a", "b", "x"), (1, "b", "c", None), (2, "a", "b", "x")], "ord long, src string, dst string, p string")
    return from_tables(nodes, edges, {"p": "s", "n": "n", "f": "b"}, {"p": "s"}, ["s"])


@pytest.mark.parametrize("text", [
    "subgraph node.p = x", "subgraph node.p != x", "subgraph node.n = 1", "subgraph node.f = true traverse out 1", "subgraph not node.n exists", "make node.p = z where node.f exists", "make node.n = z where node.p = x",
    "remove node.n where exists", "make edge.q = 1 where edge.p = x", "remove edge.p where edge.p = x", "collapse into K where node.n exists", "(make node.n = k where node.p = y) as A | A + *", "(subgraph node.p = x) as A | * - A", "(make node.f = true where exists) as A | A ^ *",
])
def test_columns_behave_as_the_map(spark, text):
    graph = shredded(spark)
    in_map = graph.in_map("node").in_map("edge")
    assert not in_map.node_columns and "n" in graph.node_columns
    assert canonical(query(graph, text)) == canonical(query(in_map, text))


def test_filters_reach_the_scan(spark):
    from weftgraph.plans.table_graphs import containment

    plan = query(containment(spark, "/root/testdata/sf0.001"), 'subgraph node.segment == "BUILDING"').nodes._jdf.queryExecution().executedPlan().toString()
    assert "EqualNullSafe(c_mktsegment,BUILDING)" in plan.replace(" ", "") or "EqualTo(c_mktsegment,BUILDING)" in plan.replace(" ", "")


def test_named_graphs_outlive_a_query(spark):
    context = Context(parse("node a [p=\"x\"] node b a->b").graph(spark))
    run(context, "(subgraph node.p = x) as ONE")
    assert canonical(run(context, "from ONE")) == 'node a [p="x"]'
    with pytest.raises(q.QueryError):
        run(context, "(from *) as ONE")
    with pytest.raises(q.QueryError):
        run(context, "from TWO")


@pytest.mark.parametrize("text", ["subgraph node.a = 1 AND edge.b = 2", "collapse into X where edge.a = 1", "A + B", "from NONE"])
def test_errors_of_a_run(spark, text):
    with pytest.raises(q.QueryError):
        query(parse("a->b").graph(spark), text)


def test_sets_and_references(spark):
    graph = parse("set s [w=2]\nnode a [ref=b, flag] @s\nnode b [parent=a]\na->b @s").graph(spark)
    assert canonical(query(graph, "subgraph node in @s")) == "set s [w=2]\n\nnode a [flag, ref=b] @s"
    assert canonical(query(graph, "subgraph node.ref = b")) == "set s [w=2]"
    assert query(graph, "").nodes.filter("parent = 'a'").count() == 1
    assert NodeRef("b") != 5


DEEP = """
A: a->b
B: b->c [parent=A]
C: c->d [parent=B]
D: d->e [parent=C]
E: e->f [parent=D]
e->g [parent=E]
X: a->x [parent=Y]
Y: x->y [parent=Z]
Z: y->z [parent=X]
W: z->w [parent=X]
w->v [parent=W]
P: p->q [parent=Q] { p->r }
Q: q->p [parent=D]
"""


def test_depths_of_chains_cycles_and_labels_used_twice(spark):
    from weftgraph.operators.traverse import with_depth

    twice = parse(DEEP)
    twice.edges += [EdgeRow("a", "b", "A", "E"), EdgeRow("a", "b", "P", "P"), EdgeRow("a", "c", "", "unknown"), EdgeRow("c", "a", "Q", "P")]
    rng = random.Random(77)
    drawn = Definition(edges=[EdgeRow("a", "b", rng.choice(["", *"KLMNOPQR"]), rng.choice(["", "gone", *"KLMNOPQR"])) for _ in range(60)])
    for rows in (parse(DEEP), twice, drawn):
        plain = plain_engine.Graph(rows)
        got = {r["ord"]: r["_depth"] for r in with_depth(rows.graph(spark).edges).collect()}
        assert got == {k: plain.depth(e) for k, e in enumerate(rows.edges)}


def test_levels_of_a_long_chain(spark):
    from weftgraph.operators import patterns

    names = [f"n{k}" for k in range(14)]
    text = "\n".join(f"{a}->{b}" for a, b in zip(names, names[1:])) + "\nn0->n13\nx->y y->x\nx->n5x\nnode alone"
    got = {r.id: r.level for r in patterns.topological_levels(parse(text.replace(" y->x", "\ny->x")).graph(spark)).collect()}
    assert got == {**{n: k for k, n in enumerate(names)}, "alone": 0}


def test_large_graphs_are_not_broadcast_for_the_size_of_their_files(spark, monkeypatch):
    monkeypatch.setattr(lineage, "MOST_BROADCAST", 3, raising=False)
    nodes = spark.range(12).selectExpr("concat('n', id) AS id", "if(id < 8, 'a', 'b') AS kind", "if(id >= 4, 'yes', 'no') AS late")
    edges = spark.range(11).selectExpr("id AS ord", "concat('n', id) AS src", "concat('n', id + 1) AS dst")
    graph = from_tables(nodes, edges, {"kind": "s", "late": "s"}, {})

    def made(text):
        found = query(graph, text)
        plans = [t._jdf.queryExecution().executedPlan().toString() for t in (found.nodes, found.edges)]
        return {r.id for r in found.nodes.collect()}, {r.src for r in found.edges.collect()}, plans

    ids, sources, plans = made("(subgraph node.kind = a) as A | (subgraph node.late = yes) as B | A ^ B")
    assert (ids, sources) == ({f"n{k}" for k in (0, 1, 2, 3, 8, 9, 10, 11)}, {f"n{k}" for k in (0, 1, 2, 8, 9, 10)})
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
    assert "BroadcastHashJoin" in made("(subgraph node.kind = a) as A | (subgraph node.id = n9) as B | A ^ B")[2][0]


def test_a_small_graph_does_not_deal_out_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(lineage, "MOST_BROADCAST", 3, raising=False)
    nodes = spark.range(40).selectExpr("concat('n', id) AS id", "if(id < 30, 'a', 'b') AS kind")
    edges = spark.range(39).selectExpr("id AS ord", "concat('n', id) AS src", "concat('n', id + 1) AS dst")
    graph = from_tables(nodes, edges, {"kind": "s"}, {})
    for pair in ("A ^ B", "B ^ A"):
        found = query(graph, f"(subgraph node.kind = a) as A | (subgraph node.id = n35) as B | {pair}")
        assert "SortMergeJoin" not in found.nodes._jdf.queryExecution().executedPlan().toString()
        assert {r.id for r in found.nodes.collect()} == {f"n{k}" for k in (*range(30), 35)}
        assert [r.src for r in found.edges.orderBy("ord").collect()] == [f"n{k}" for k in range(29)]
        ordered, plain = (t._jdf.queryExecution().optimizedPlan().toString() for t in (found.edges, found.edges.drop("ord")))
        assert "scalar-subquery" in ordered and "scalar-subquery" not in plain

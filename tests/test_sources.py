import pytest

from weftgraph.model import from_tables
from weftgraph.operators import mutate, patterns
from weftgraph.plans.query_text import QueryError
from weftgraph.sources.definition import DefinitionError, parse, read_file, read_files, read_graph
from weftgraph.sources.writer import canonical, write_text


def test_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("node a\na->b")
    (tmp_path / "two.txt").write_text("node a [n=1] @s")
    (tmp_path / "bad.txt").write_text("node")
    assert canonical(read_file(spark, f"{tmp_path}/one.txt")) == "node a\nnode b\n\na->b"
    rows = read_files(spark, str(tmp_path)).collect()
    found = sorted((r.path.rpartition("/")[2], r.kind, (r.node or r.edge or r.group or [None])[0]) for r in rows if r.kind != "error")
    assert found == [("one.txt", "edge", 0), ("one.txt", "node", "a"), ("one.txt", "node", "b"), ("two.txt", "node", "a"), ("two.txt", "set", "s")]
    assert [r.path.rpartition("/")[2] for r in rows if r.kind == "error"] == ["bad.txt"]


def test_questions(spark):
    g = parse("node a [k] node b [k, m=1]\na->b a->c b->d c->d d->e").graph(spark)
    assert {(r.attribute, r.n) for r in patterns.attribute_usage(g).collect()} == {("k", 2), ("m", 1)}
    assert {r.id for r in patterns.neighbours(g, "a").collect()} == {"b", "c"}
    assert {r.id: r.neighbours for r in patterns.adjacency(g).collect()}["a"] == ["b", "c"]
    assert patterns.topological_order(g) == ["a", "b", "c", "d", "e"] and not patterns.has_cycle(g)
    assert sorted(tuple(r.path) for r in patterns.simple_paths(g, "a", "e").collect()) == [("a", "b", "d", "e"), ("a", "c", "d", "e")]
    assert patterns.has_cycle(parse("a->b b->a c->a").graph(spark)) and patterns.has_cycle(parse("a->a").graph(spark))


FILES = {"a.txt": 'set s [w=1]\nnode x [k=1, m="old"] @s\nL: x->y { y->z }', "b.txt": 'node x [m="new", n] @t\nset t\nz->x [parent=L]\nnode y { node inner }', "c.txt": "set s [v=2]\nM: z->z"}


def test_one_graph_of_many_files(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    got, want = read_graph(spark, str(tmp_path)), parse("\n".join(FILES.values()))
    assert canonical(got, keep_parents=True) == canonical(want, keep_parents=True)
    assert sorted((r.id, r.parent) for r in got.nodes.collect()) == sorted((n.id, n.parent) for n in want.nodes.values())
    assert [r.scope_depth for r in got.edges.orderBy("ord").collect()] == [e.scope_depth for e in want.edges]
    for text in ("L: a->b", "a->b [parent=nowhere]", "node"):
        (tmp_path / "d.txt").write_text(text)
        with pytest.raises(DefinitionError):
            read_graph(spark, str(tmp_path))


def test_text_written_by_spark_reads_back(spark, tmp_path):
    text = 'set s [w=0.5]\nnode a [k="q\\"\\\\ \\n\\t", n=10000000000000000000000, e, t=false, small=0.0000001] @s\nnode b [parent=a]\nL: a->b,c [x=1] @s { c->a }\nb->a'
    graph = parse(text).graph(spark)
    write_text(graph, f"{tmp_path}/out")
    found = "\n".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert canonical(parse(found), keep_parents=True) == canonical(graph, keep_parents=True)
    shredded = from_tables(spark.createDataFrame([("a", "x", 2.0), ("b", None, 0.25)], "id string, p string, n double"), spark.createDataFrame([(0, "a", "b", True)], "ord long, src string, dst string, f boolean"), {"p": "s", "n": "n"}, {"f": "b"}, ["s"])
    write_text(shredded, f"{tmp_path}/more")
    found = "\n".join(p.read_text() for p in sorted((tmp_path / "more").glob("part-*")))
    assert found.split("\n")[:4] == ["set s", 'node a [n=2, p="x"]', "node b [n=0.25]", "a->b [f=true]"]


def test_changes_that_are_refused(spark):
    g = parse("node lone\na->b").graph(spark)
    for wrong in (lambda: mutate.remove_node(g, "a"), lambda: mutate.remove_node(g, "zz"), lambda: mutate.remove_edge(g, "b", "a"), lambda: mutate.add_edges(g, parse("a->zz").graph(spark).edges)):
        with pytest.raises(QueryError):
            wrong()
    more = mutate.add_sets(mutate.put_sets(g, parse("set s [w=1]").graph(spark).sets), parse("set s\nset t").graph(spark).sets)
    assert canonical(mutate.remove_node(more, "lone")) == "set s [w=1]\nset t\n\nnode a\nnode b\n\na->b"

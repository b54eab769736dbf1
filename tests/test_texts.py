"""The two languages and the diagrams, without Spark."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.model import EMPTY, NodeRef
from weftgraph.plans import query_text as q
from weftgraph.sources.definition import DefinitionError, parse
from weftgraph.sources.diagrams import messages, render
from weftgraph.sources.writer import canonical, number


def test_statements():
    d = parse('# all\nset s [w=1.50]\nnode a [k="v\\n\\"\\q", n=3., t=true, e, r=b] @s\nnode b: "txt"\nL: a,b->c [x=2]: "hi" @s @new {\n  node z\n  c->d\n}\nd->e [parent=L]')
    assert d.nodes["a"].attrs == {"k": 'v\n"\\q', "n": 3.0, "t": True, "e": EMPTY, "r": NodeRef("b")} and d.nodes["b"].attrs == {"text": "txt"}
    assert [(e.src, e.dst, e.label, e.parent, e.scope_depth) for e in d.edges] == [("a", "c", "L", "", 0), ("b", "c", "L", "", 0), ("c", "d", "", "L", 1), ("d", "e", "", "L", 0)]
    assert d.edges[0].attrs == {"text": "hi", "x": 2.0} and d.edges[1].sets == {"s", "new"} and not d.sets["new"].declared
    assert d.warnings == ["set 'new' isn't declared"] and d.children() == {0: [2, 3]}


def test_nodes_in_blocks():
    d = parse("node p {\n node c [parent=x] {\n node g\n }\n node h\n} @s\nnode h [k]")
    assert {i: n.parent for i, n in d.nodes.items()} == {"p": None, "c": "x", "g": "c", "h": "p"}
    assert d.nodes["p"].sets == {"s"} and len(d.warnings) == 2 and d.nodes["h"].attrs == {"parent": NodeRef("p"), "k": EMPTY}


@pytest.mark.parametrize("text", ["node", "node set", "a->", "a,b->c,d", "node a [k=1, k=2]", "set s [r=a]", "a->b [r=c]", "a->b [parent]", "a->b [parent=no]", "L: a->b\nL: a->c", "L: a->b { c->d [parent=L] }", 'node a [k="open]', "a - b", "node a {", "a->b {", "node a { set s }", "node true"])
def test_definitions_that_are_none(text):
    with pytest.raises(DefinitionError):
        parse(text)


@pytest.mark.parametrize("text", ["set s\n\nnode a [n=1] {\n    node b\n} @s\n\na->b", 'L: a,b->c [k="v"] {\n    c->d\n}', "L: a->b,c", "node a [e, n=10000000000000000000000, t=false]"])
def test_canonical_text_stays(text):
    once = canonical(parse(text))
    assert canonical(parse(once)) == once and (text in once)


def test_cycles_and_lost_parents():
    d = parse("A: a->b [parent=B]\nB: b->c [parent=A]")
    assert "parent" not in canonical(d) and canonical(parse(canonical(d, keep_parents=True)), keep_parents=True) == canonical(d, keep_parents=True)
    assert canonical(parse("node a [parent=b]\nnode b [parent=a]")) == "node a [parent=b]\nnode b [parent=a]"


def test_order_of_nodes():
    """Both ends of an edge have its place; ids decide between equal places."""
    assert canonical(parse("node z\nb->a\nc->a\nnode y")) == "node a\nnode b\nnode c\nnode y\nnode z\n\nb->a\nc->a"


def test_numbers():
    assert [number(x) for x in (5.0, 0.5, 1e21, 1e-7, 123456789.25)] == ["5", "0.5", "1000000000000000000000", "0.0000001", "123456789.25"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_parses_or_is_refused(text):
    for reader, error in ((parse, DefinitionError), (q.parse, q.QueryError)):
        try:
            reader(text)
        except error:
            pass


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("klm"), st.text(max_size=20) | st.booleans() | st.floats(0, 1e15, allow_nan=False)))
def test_values_come_back(attrs):
    d = parse("node a")
    d.nodes["a"].attrs = attrs
    assert parse(canonical(d)).nodes["a"].attrs == attrs


def test_queries():
    assert q.parse("") == q.parse("# only this") == ()
    assert q.parse("from *") == (q.From("*"),)
    assert q.parse('subgraph not node.a = "x" AND in s scope') == (q.Subgraph(q.Not(q.And(q.Compare("node", "a", True, "x"), q.Member("", "s"))), ("down",), q.UNBOUNDED),)
    assert q.parse("subgraph edge.depth exists traverse in up +2") == (q.Subgraph(q.Always(), ("in", "up"), 2),)
    assert q.parse("make node.p = -1.5 where edge depends on edge.q != true") == (q.Make("node", "p", "-1.5", q.DependsOn(q.Compare("edge", "q", False, True))),)
    assert q.parse("(subgraph exists) as A_1 | A_1 ^ *") == (q.Bind((q.Subgraph(q.Always()),), "A_1"), q.Algebra("A_1", "^", "*"))


@pytest.mark.parametrize("text", ["subgraph", "subgraph node", "subgraph node.a", "subgraph node.a = ", "subgraph exists traverse", "subgraph exists traverse 2", "subgraph exists traverse in 0", "subgraph exists traverse in -1", "subgraph exists traverse in 1.5", "subgraph exists traverse all all", "subgraph edge.depth = x", "make node.a = 1", "make node.a == 1 where exists", "remove node where exists", "remove edge", "collapse into X", "from abc", "(from *) as abc", "(from *)", "A + B + C", "subgraph a OR b", "from * |", "| from *", "subgraph node.a < 3"])
def test_queries_that_are_none(text):
    with pytest.raises(q.QueryError):
        q.parse(text)


def test_building_by_hand():
    d = parse("")
    assert d.add_node("a", {"parent": NodeRef("b")}).parent == "b" and d.add_node("a") is d.nodes["a"]
    d.add_node("b")
    d.add_edge("a", "b")
    d.add_edge("a", "b", {"second": True})
    for wrong in (lambda: d.add_edge("a", "zz"), lambda: d.remove_node("a"), lambda: d.remove_node("zz"), lambda: d.remove_edge("b", "a")):
        with pytest.raises(DefinitionError):
            wrong()
    d.remove_edge("a", "b")
    assert [e.attrs for e in d.edges] == [{"second": True}]


def test_diagrams():
    d = parse('node g: "Group" {\n node x\n node y: "Why"\n}\nnode z [shape="actor"]\nx->y [label="calls"]\ny->z')
    assert render(d) == 'graph TB\n  subgraph g["Group"]\n    x["x"]\n    y["Why"]\n  end\n  z["z"]\n\n  x -->|calls| y\n  y --> z\n'
    assert render(d, "plantuml") == '@startuml\n\npackage "Group" as g {\n  component x\n  component y\n}\ncomponent z\n\nx --> y : calls\ny --> z\n\n@enduml\n'
    assert render(d, "mermaid", "graph").startswith("graph TD\n  g")
    with pytest.raises(ValueError):
        render(d, "other")
    s = parse('node u: "a\\nb"\nu->v {\n v->w {\n w->v\n }\n}\nu->w [activate]\nL: u->v: "go"\nv->u [parent=L, arrow="return"]')
    assert [(m.edge.dst, m.opens, len(m.inner)) for m in messages(s)] == [("v", True, 1), ("w", True, 0), ("v", True, 1)]
    assert render(s, "plantuml", "sequence") == '@startuml\n\nparticipant u as "a\\nb"\nparticipant v\nparticipant w\n\nu -> v ++\n    v -> w ++\n        w -> v\n    return\nreturn\n\nu -> w ++\nreturn\n\nu -> v ++: go\n    v --> u\nreturn\n\n@enduml\n'
    assert render(s, "mermaid", "sequence") == "sequenceDiagram\n    participant u as a b\n    participant v\n    participant w\n    u ->>+ v:\n        v ->>+ w:\n            w ->> v:\n        deactivate w\n    deactivate v\n    u ->>+ w:\n    deactivate w\n    u ->>+ v: go\n        v -->> u:\n    deactivate v\n"

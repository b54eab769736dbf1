from weftgraph.cli import main


def test_query_and_diagram(spark, tmp_path, capsys):
    graph, out = tmp_path / "g", tmp_path / "o"
    graph.write_text('node a [k="v"]\na->b @s')
    assert main(["query", "-i", str(graph), "-o", str(out), 'subgraph node.k = "v"']) == 0
    assert out.read_text() == 'set s\n\nnode a [k="v"]\n'
    assert "isn't declared" in capsys.readouterr().err
    (tmp_path / "q").write_text("remove orphans")
    assert main(["query", "-i", str(graph), "-f", str(tmp_path / "q")]) == 0
    assert "a->b @s" in capsys.readouterr().out
    assert main(["diagram", "-i", str(graph), "--language", "plantuml", "-o", str(out)]) == 0 and "a --> b" in out.read_text()


def test_errors(tmp_path, capsys):
    graph = tmp_path / "g"
    graph.write_text("node")
    assert main(["query", "-i", str(graph), "exists"]) == 1 and "error" in capsys.readouterr().err
    assert main(["diagram", "-i", str(tmp_path / "none")]) == 1
    graph.write_text("a->b")
    assert main(["query", "-i", str(graph), "nonsense"]) == 1 and main(["diagram", "-i", str(graph), "--language", "x"]) == 1

"""Command line.

    python -m weftgraph.cli query [-i graph.txt] [-f query.txt | QUERY] [-o out.txt]
    python -m weftgraph.cli diagram [-i graph.txt] [--language mermaid|plantuml] [--kind component|graph|sequence] [-o out]

Without -i and -o, standard input and output.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def _read(path: str | None) -> str:
    return Path(path).read_text(encoding="utf-8") if path and path != "-" else sys.stdin.read()


def _write(path: str | None, text: str) -> None:
    if path and path != "-":
        Path(path).write_text(text + "\n" * (not text.endswith("\n")), encoding="utf-8")
    else:
        print(text)


def main(argv: list[str] | None = None) -> int:
    from .plans.query_text import QueryError
    from .sources.definition import DefinitionError, parse
    from .sources.diagrams import render
    from .sources.writer import canonical

    parser = argparse.ArgumentParser(prog="weftgraph")
    commands = parser.add_subparsers(dest="command", required=True)
    asked = commands.add_parser("query")
    asked.add_argument("query", nargs="?")
    asked.add_argument("-f", "--file")
    drawn = commands.add_parser("diagram")
    drawn.add_argument("--language", default="mermaid")
    drawn.add_argument("--kind", default="component")
    for command in (asked, drawn):
        command.add_argument("-i", "--input")
        command.add_argument("-o", "--output")
    args = parser.parse_args(argv)
    try:
        graph = parse(_read(args.input))
        for warning in graph.warnings:
            print(f"warning: {warning}", file=sys.stderr)
        if args.command == "diagram":
            _write(args.output, render(graph, args.language, args.kind))
            return 0
        from pyspark.sql import SparkSession

        from .plans.session import query

        text = _read(args.file) if args.file else args.query or ""
        spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
        _write(args.output, canonical(query(graph.graph(spark), text)))
    except (DefinitionError, QueryError, ValueError, OSError) as wrong:
        print(f"error: {wrong}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

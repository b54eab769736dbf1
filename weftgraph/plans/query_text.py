"""The query language: text to a tree of stages and predicates.

    query := [stage {"|" stage}]
    stage := "(" query ")" "as" NAME | "subgraph" pred ["scope"] ["traverse" dir+ ("all" | N)]
           | "make" kind.ID "=" value "where" pred | "remove" ("orphans" | "edge" "where" pred | kind.ID "where" pred)
           | "collapse" "into" ID "where" pred | "from" ("*" | NAME) | ref ("+" | "&" | "-" | "^") ref
    pred  := term {"AND" term}; "not" and "depends on" reach as far right as they can
"""

from __future__ import annotations

import re
from dataclasses import dataclass

UNBOUNDED = 999_999
DIRECTIONS = ("in", "out", "both", "up", "down")
#: The tokens of the language.
_TOKENS = re.compile(r'(?P<comment>#[^\n]*)|(?P<string>"[^"]*")|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+))|(?P<op>==|!=|=|\||\(|\)|\.|@|[+&\-^*])|(?P<id>[A-Za-z_][A-Za-z0-9_]*)|(?P<space>\s+)')
_GRAPH_NAME = re.compile(r"[A-Z][A-Z0-9_]*")


class QueryError(ValueError):
    """A query that can't be parsed, analysed or run."""


# ---- predicates; target is "node", "edge", "" (either) or "mixed" -----------------------------------------


@dataclass(frozen=True)
class Always:
    value: bool = True
    target: str = ""


#: All nodes, and all edges, for callers that build stages by hand; the language only has `exists`, on either.
ALL_NODES, ALL_EDGES = Always(target="node"), Always(target="edge")


@dataclass(frozen=True)
class Compare:
    target: str
    name: str
    equal: bool
    value: object


@dataclass(frozen=True)
class Has:
    target: str
    name: str
    present: bool = True


@dataclass(frozen=True)
class Member:
    target: str
    group: str
    inside: bool = True


@dataclass(frozen=True)
class HasParent:
    target: str
    present: bool = True


@dataclass(frozen=True)
class Depth:
    depth: int
    equal: bool = True
    target: str = "edge"


@dataclass(frozen=True)
class DependsOn:
    inner: object
    target: str = "edge"


@dataclass(frozen=True)
class Not:
    inner: object

    @property
    def target(self) -> str:
        return self.inner.target


@dataclass(frozen=True)
class And:
    left: object
    right: object

    @property
    def target(self) -> str:
        kinds = {self.left.target, self.right.target} - {""}
        return "" if not kinds else kinds.pop() if len(kinds) == 1 else "mixed"


# ---- stages -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Bind:
    stages: tuple
    name: str


@dataclass(frozen=True)
class Subgraph:
    pred: object
    directions: tuple[str, ...] = ()
    depth: int = 0


@dataclass(frozen=True)
class Make:
    kind: str
    name: str
    value: object
    pred: object


@dataclass(frozen=True)
class RemoveOrphans:
    pass


@dataclass(frozen=True)
class RemoveEdges:
    pred: object


@dataclass(frozen=True)
class RemoveAttribute:
    kind: str
    name: str
    pred: object


@dataclass(frozen=True)
class Collapse:
    into: str
    pred: object


@dataclass(frozen=True)
class From:
    name: str


@dataclass(frozen=True)
class Algebra:
    left: str
    op: str
    right: str


class _Reader:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            found = _TOKENS.match(text, at)
            if not found:
                raise QueryError(f"unexpected {text[at]!r} at {at}")
            if found.lastgroup not in ("comment", "space"):
                self.tokens.append((found.lastgroup, found.group()))
            at = found.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else ("end", "")

    def sees(self, *texts: str) -> bool:
        return all(self.peek(k)[0] in ("id", "op") and self.peek(k)[1] == t for k, t in enumerate(texts))

    def take(self, *texts: str) -> bool:
        if self.sees(*texts):
            self.at += len(texts)
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise QueryError(f"expected {text!r}, found {self.peek()[1]!r}")

    def need_id(self) -> str:
        kind, text = self.peek()
        if kind != "id":
            raise QueryError(f"expected a name, found {text!r}")
        self.at += 1
        return text


def parse(text: str) -> tuple:
    """The stages of a query, in order; none for an empty one."""
    r = _Reader(text)
    stages = _query(r, inside=False)
    if r.peek()[0] != "end":
        raise QueryError(f"unexpected {r.peek()[1]!r}")
    return stages


def _query(r: _Reader, inside: bool) -> tuple:
    if r.peek()[0] == "end" or inside and r.sees(")"):
        return ()
    stages = [_stage(r)]
    while r.take("|"):
        stages.append(_stage(r))
    return tuple(stages)


def _graph_name(r: _Reader) -> str:
    name = r.need_id()
    if not _GRAPH_NAME.fullmatch(name):
        raise QueryError(f"{name!r} is no graph name: capitals, digits and _ only, from a capital on")
    return name


def _reference(r: _Reader) -> str:
    return "*" if r.take("*") else r.need_id()


def _stage(r: _Reader):
    if r.take("("):
        stages = _query(r, inside=True)
        r.need(")")
        r.need("as")
        return Bind(stages, _graph_name(r))
    kind, text = r.peek()
    after = r.peek(1)
    if (kind == "id" or text == "*") and after[0] == "op" and after[1] in "+&-^":
        left, op = _reference(r), r.peek()[1]
        r.at += 1
        return Algebra(left, op, _reference(r))
    if r.take("subgraph"):
        pred = _pred(r)
        directions, depth = (("down",), UNBOUNDED) if r.take("scope") else ((), 0)
        if r.take("traverse"):
            directions, depth = _traversal(r)
        return Subgraph(pred, directions, depth)
    if r.take("make"):
        kind, name = _path(r)
        r.need("=")
        value = _value(r)
        r.need("where")
        return Make(kind, name, value, _pred(r))
    if r.take("remove"):
        if r.take("orphans"):
            return RemoveOrphans()
        if r.take("edge", "where"):
            return RemoveEdges(_pred(r))
        kind, name = _path(r)
        r.need("where")
        return RemoveAttribute(kind, name, _pred(r))
    if r.take("collapse"):
        r.need("into")
        into = r.need_id()
        r.need("where")
        return Collapse(into, _pred(r))
    if r.take("from"):
        return From("*" if r.take("*") else _graph_name(r))
    raise QueryError(f"no stage begins with {text!r}")


def _traversal(r: _Reader) -> tuple[tuple[str, ...], int]:
    directions = []
    while r.peek()[0] == "id" and r.peek()[1] in DIRECTIONS:
        directions.append(r.need_id())
    if not directions:
        raise QueryError(f"expected a direction, found {r.peek()[1]!r}")
    if r.take("all"):
        return tuple(directions), UNBOUNDED
    return tuple(directions), _whole(r, least=1)


def _whole(r: _Reader, least: int) -> int:
    kind, text = r.peek()
    if kind != "number" or not re.fullmatch(r"[-+]?\d+", text) or int(text) < least:
        raise QueryError(f"{text!r} is no depth")
    r.at += 1
    return int(text)


def _path(r: _Reader) -> tuple[str, str]:
    kind = r.need_id()
    if kind not in ("node", "edge"):
        raise QueryError(f"expected node or edge, found {kind!r}")
    r.need(".")
    return kind, r.need_id()


def _value(r: _Reader) -> object:
    """A string; numbers and bare names are strings too, and only true and false are not."""
    kind, text = r.peek()
    if kind not in ("string", "number", "id"):
        raise QueryError(f"expected a value, found {text!r}")
    r.at += 1
    if kind == "string":
        return text[1:-1]
    return text == "true" if kind == "id" and text in ("true", "false") else text


def _pred(r: _Reader):
    left = _term(r)
    return And(left, _pred(r)) if r.take("AND") else left


def _term(r: _Reader):
    if r.take("exists"):
        return Always()
    if r.sees("in") and r.peek(1)[0] == "id":
        r.at += 1
        return Member("", r.need_id())
    if r.sees("not", "in") and r.peek(2)[0] == "id":
        r.at += 2
        return Member("", r.need_id(), False)
    if r.take("not"):
        return Not(_pred(r))
    kind = r.peek()[1]
    if kind in ("node", "edge") and r.peek()[0] == "id" and not r.peek(1)[1] == ".":
        r.at += 1
        if r.take("in", "@"):
            return Member(kind, r.need_id())
        if r.take("not", "in", "@"):
            return Member(kind, r.need_id(), False)
        if r.take("depends", "on"):
            return DependsOn(_pred(r))
        if r.take("parent", "exists"):
            return HasParent(kind)
        if r.take("parent", "not", "exists"):
            return HasParent(kind, False)
        raise QueryError(f"unexpected {r.peek()[1]!r} after {kind}")
    kind, name = _path(r)
    depth = (kind, name) == ("edge", "depth")
    if r.take("exists"):
        return Always() if depth else Has(kind, name)
    if r.take("not", "exists"):
        return Not(Always()) if depth else Has(kind, name, False)
    for sign in ("==", "=", "!="):
        if r.take(sign):
            if depth:
                return Depth(_whole(r, least=-UNBOUNDED), sign != "!=")
            return Compare(kind, name, sign != "!=", _value(r))
    raise QueryError(f"unexpected {r.peek()[1]!r} after {kind}.{name}")

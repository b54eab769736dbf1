"""Union, intersection, difference and symmetric difference of two graphs.

Nodes and sets are matched by id, edges by their ends; copies of an edge are all kept or all dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import by_rows, by_shuffle, cut, few
from ..model import PREFIX, PGraph, merged, no_attrs, no_sets


def _alike(left: PGraph, right: PGraph) -> tuple[PGraph, PGraph]:
    """Both graphs with the same attributes shredded: those that are in both, with the same tag."""
    for kind in ("node", "edge"):
        a, b = left.columns_of(kind), right.columns_of(kind)
        left = left.in_map(kind, {n for n in a if b.get(n) != a[n]})
        right = right.in_map(kind, {n for n in b if a.get(n) != b[n]})
    return left, right


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges between nodes, whose ids are met twice and so written once."""
    ids, names = by_rows(cut(nodes.select("id"))), edges.columns
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*names)


def _after(edges: DataFrame, before: DataFrame) -> DataFrame:
    """edges with places in the order after those of `before`."""
    last = before.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).scalar()
    first = edges.agg(F.coalesce(F.min("ord"), F.lit(0))).scalar()
    return edges.withColumn("ord", F.col("ord") - first + last)  # subqueries: plans that don't need the order lose them


def union(left: PGraph, right: PGraph) -> PGraph:
    """All nodes, edges and sets. Where both have an id, attributes of the right one win and memberships are united."""
    left, right = _alike(left, right)

    def both(a: DataFrame, b: DataFrame, columns: list[str], more: dict) -> DataFrame:
        b = b.select(*(F.col(f"`{c}`").alias(f"_r_{c}") for c in b.columns))
        joined = a.join(b, F.col("id") == F.col("_r_id"), "full_outer")
        attrs = merged(F.coalesce("attrs", no_attrs()), F.coalesce("_r_attrs", no_attrs()))
        shred = [F.coalesce(F.col(f"`_r_{PREFIX}{c}`"), F.col(f"`{PREFIX}{c}`")).alias(PREFIX + c) for c in columns]
        return joined.select(F.coalesce("id", "_r_id").alias("id"), attrs.alias("attrs"), *shred, *(v.alias(k) for k, v in more.items()))

    kept = F.when(F.col("id").isNotNull(), F.col("parent")).otherwise(F.col("_r_parent"))
    nodes = both(left.nodes, right.nodes, list(left.node_columns), {"parent": kept, "sets": F.array_union(F.coalesce("sets", no_sets()), F.coalesce("_r_sets", no_sets()))})
    sets = both(left.sets, right.sets, [], {"declared": F.coalesce("declared", F.lit(False)) | F.coalesce("_r_declared", F.lit(False))})
    edges = left.edges.unionByName(_after(right.edges, left.edges))
    return left.with_(nodes=nodes.select(*left.nodes.columns), edges=edges, sets=sets.select(*left.sets.columns))


def intersection(left: PGraph, right: PGraph) -> PGraph:
    """What both have, as the left one has it."""
    nodes = left.nodes.join(right.nodes.select("id"), "id", "left_semi")
    edges = left.edges.join(right.edges.select("src", "dst"), ["src", "dst"], "left_semi").select(*left.edges.columns)
    return left.with_(nodes=nodes, edges=_inside(edges, nodes), sets=left.sets.join(right.sets.select("id"), "id", "left_semi"))


def difference(left: PGraph, right: PGraph) -> PGraph:
    """What only the left one has; an edge also needs both its ends."""
    nodes = left.nodes.join(right.nodes.select("id"), "id", "left_anti")
    edges = left.edges.join(right.edges.select("src", "dst"), ["src", "dst"], "left_anti").select(*left.edges.columns)
    return left.with_(nodes=nodes, edges=_inside(edges, nodes), sets=left.sets.join(right.sets.select("id"), "id", "left_anti"))


def _only(a: DataFrame, b: DataFrame, of_a: DataFrame, key: list[str]) -> DataFrame:
    """a without what b has by key. of_a: a as it was written; if its rows are few, b is brought down to what they name
    instead of being dealt out whole."""
    if few(b):
        met = b.select(*key)
    elif few(of_a):
        met = b.select(*key).join(of_a.select(*key), key, "left_semi").distinct()
    else:
        met = by_shuffle(b.select(*key))
    return a.join(met, key, "left_anti").select(*a.columns)


def symmetric_difference(left: PGraph, right: PGraph) -> PGraph:
    """What exactly one of them has, the left one's edges first."""
    (ln, le), (rn, re) = ((g.nodes, g.edges) for g in (left, right))  # as they were written
    left, right = _alike(left, right)
    nodes = _only(left.nodes, rn, ln, ["id"]).unionByName(_only(right.nodes, ln, rn, ["id"]))
    sets = left.sets.join(right.sets, "id", "left_anti").unionByName(right.sets.join(left.sets, "id", "left_anti"))
    names, ends = left.edges.columns, ["src", "dst"]
    edges = _only(left.edges, re, le, ends).unionByName(_after(_only(right.edges, le, re, ends).select(*names), left.edges))
    return left.with_(nodes=nodes, edges=_inside(edges, nodes), sets=sets)


OPERATORS: dict[str, Callable[[PGraph, PGraph], PGraph]] = {"+": union, "&": intersection, "-": difference, "^": symmetric_difference}

"""Walks over graph structure (in, out, both) and over the forest of edges that depend on edges (up, down).

Each hop is a join of the frontier with the edges, less what was seen before; it is written out before the next one,
so plans stay short and a lost executor costs one hop. Frontiers are broadcast when Spark finds them small, else
shuffled: no size is assumed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..model import PGraph
from ..plans.query_text import UNBOUNDED

STRUCTURE = ("in", "out", "both")
_COMPACT_EVERY = 12


def ends(edges: DataFrame) -> DataFrame:
    """Distinct ids of the endpoints of edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def induced(graph: PGraph, ids: DataFrame) -> PGraph:
    """The nodes with these ids, the edges between them, and all sets."""
    ids = ids.select("id")
    edges = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return graph.with_(nodes=graph.nodes.join(ids, "id", "left_semi"), edges=edges)


def _together(parts: list[DataFrame]) -> list[DataFrame]:
    return [cut(reduce(DataFrame.unionByName, parts))] if len(parts) >= _COMPACT_EVERY else parts


def reach(edges: DataFrame, start: DataFrame, directions: tuple[str, ...], depth: int) -> DataFrame:
    """Ids within `depth` hops of start; each hop may take any of the directions."""
    sides = []
    if "out" in directions or "both" in directions:
        sides.append(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    if "in" in directions or "both" in directions:
        sides.append(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    frontier = start.select("id").distinct()
    if not sides:
        return frontier
    step = reduce(DataFrame.unionByName, sides).filter("u <> v")
    if depth > 1:
        step, frontier = cut(step), cut(frontier)
    seen = [frontier]
    for hop in range(depth):
        known = reduce(DataFrame.unionByName, seen)
        found = step.join(frontier.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("id")).distinct().join(known, "id", "left_anti")
        if hop == depth - 1:
            return known.unionByName(found)
        frontier = cut(found)
        if frontier.isEmpty():
            return known
        seen = _together([*seen, frontier])
    return reduce(DataFrame.unionByName, seen)


def labels(edges: DataFrame, last: bool, *names: str) -> DataFrame:
    """One edge for each label, the last or the first in order: label, then the columns named with a leading _."""
    pick = F.max if last else F.min
    chosen = edges.filter("label <> ''").groupBy("label").agg(pick(F.struct(F.col("ord").alias("_place"), *names)).alias("_e"))
    return chosen.select("label", *(F.col(f"_e.{n}").alias(f"_{n}") for n in names))


def _chains(above: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Of labels (at, _parent: the label above): at, _depth of those whose chain upwards ends, and at of those that
    reach a cycle, None if none does. Pointers are doubled, so rounds number the logarithm of the longest chain.

    A round that ends no chain is the last: a chain of any length has the chains of all lesser lengths above it.
    """
    state = cut(above.select("at", F.when(F.col("_parent") != "", F.col("_parent")).alias("to"), F.lit(1).alias("_depth")))
    ended, now = [state.filter("to IS NULL").select("at", "_depth")], state
    while True:
        now = now.filter("to IS NOT NULL")
        if now.isEmpty():
            return reduce(DataFrame.unionByName, ended), None
        known = now.unionByName(reduce(DataFrame.unionByName, ended).withColumn("to", F.lit(None).cast("string")))
        further = known.select(F.col("at").alias("to"), F.col("to").alias("_to"), F.col("_depth").alias("_more"))
        # A label that no edge has ends a chain one above.
        moved = now.join(further, "to", "left").select("at", F.col("_to").alias("to"), (F.col("_depth") + F.coalesce("_more", F.lit(1))).alias("_depth"))
        now = cut(moved)
        over = now.filter("to IS NULL").select("at", "_depth")
        if over.isEmpty():
            return reduce(DataFrame.unionByName, ended), now.select("at")
        ended = _together([*ended, over])


def _walked(walks: DataFrame, above: DataFrame) -> DataFrame:
    """label, parent, _depth of walks (label, parent), each walked with the labels it has met, which stops cycles."""
    now = walks.select("label", "parent", F.col("parent").alias("at"), F.lit(0).alias("depth"), F.when(F.col("label") != "", F.array("label")).otherwise(F.array().cast("array<string>")).alias("met"))
    ended = []
    while True:
        up = now.join(above, "at", "left")
        again = F.array_contains("met", F.col("at"))
        over = F.col("_parent").isNull() | (F.col("_parent") == "") | again
        moved = cut(up.select(
            "label", "parent", F.col("_parent").alias("at"), (F.col("depth") + 1).alias("depth"), F.concat("met", F.array("at")).alias("met"), over.alias("over"),
        ))
        ended.append(moved.filter("over").select("label", "parent", F.col("depth").alias("_depth")))
        now = moved.filter("NOT over").drop("over")
        if now.isEmpty():
            return reduce(DataFrame.unionByName, ended)
        ended = _together(ended)


def with_depth(edges: DataFrame) -> DataFrame:
    """edges with _depth: how many parents stand above each one; edges without a parent are met by no join.

    A label stands for its last edge. A chain ends above a label without an edge or a parent, and at a label that it has
    met, the edge's own included. Chains that meet none twice depend on the parent's label alone; only those into a
    cycle, and those of edges that their label doesn't stand for, are walked one by one.
    """
    names = edges.columns
    above = cut(labels(edges, True, "parent").withColumnRenamed("label", "at"))
    depths, circling = _chains(above)
    with_parent = edges.filter("parent <> ''")
    own = above.select(F.col("at").alias("label"), F.col("_parent").alias("_own"))
    odd = with_parent.filter("label <> ''").select("label", "parent").distinct().join(own, "label").filter("parent <> _own").select("label", "parent")
    if circling is not None:
        into = with_parent.select("label", "parent").distinct().join(circling.withColumnRenamed("at", "parent"), "parent", "left_semi")
        odd = odd.unionByName(into.select("label", "parent")).distinct()
    odd = cut(odd)
    found = with_parent.join(depths.select(F.col("at").alias("parent"), "_depth"), "parent", "left").select(*names, F.coalesce("_depth", F.lit(1)).alias("_depth"))
    if not odd.isEmpty():
        walked = _walked(odd, above).withColumnRenamed("_depth", "_walked")
        found = found.join(walked, ["label", "parent"], "left").select(*names, F.coalesce("_walked", "_depth").alias("_depth"))
    return found.unionByName(edges.filter("parent = ''").select(*names, F.lit(0).alias("_depth")))


def _incident_closure(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What one pass over the edges in order gathers: ids, grown by both ends of each edge that meets them when its turn
    comes, and those edges.

    Order matters: an edge is met only through ids that were there before it. With t(id) the place in the order from
    which on an id is there (-1 from the start), an edge at place o carries o over to its other end where t < o; the
    least such t for every id is a fixpoint, found by relaxing all edges at once.
    """
    pairs = edges.select("ord", F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select("ord", F.col("dst").alias("u"), F.col("src").alias("v")))
    least = lambda parts: parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.min("t").alias("t"))
    fresh = cut(ids.select("id", F.lit(-(2**63)).cast("long").alias("t")))
    found = [fresh]
    while True:
        # Only ids whose t has fallen have anything new to send, and only what falls is written.
        sent = pairs.join(fresh.withColumnRenamed("id", "u"), "u").filter(F.col("t") < F.col("ord")).groupBy(F.col("v").alias("id")).agg(F.min("ord").alias("new"))
        fresh = cut(sent.join(least(found), "id", "left").filter(F.col("t").isNull() | (F.col("new") < F.col("t"))).select("id", F.col("new").alias("t")))
        if fresh.isEmpty():
            break
        found.append(fresh)
        if len(found) >= _COMPACT_EVERY:
            found = [cut(least(found))]
    times = cut(least(found))
    at = lambda end: times.select(F.col("id").alias(end), F.col("t").alias(f"_{end}"))
    met = edges.join(at("src"), "src", "left").join(at("dst"), "dst", "left").filter(F.least("_src", "_dst") < F.col("ord")).drop("_src", "_dst")
    return times.select("id"), met


def follow(edges: DataFrame, ids: DataFrame, directions: tuple[str, ...], depth: int) -> DataFrame:
    """Ids gathered by walking up to parent edges and down to child edges from the edges that meet ids.

    Directions take their turns on one queue: what the first leaves behind is where the next one starts.
    """
    slim = cut(edges.select("ord", "src", "dst", "label", "parent"))
    gathered, queue = _incident_closure(slim, ids)
    queue = cut(queue)
    found, visited = [gathered], [queue.select("ord")]
    up = cut(labels(slim, True, "ord", "src", "dst", "label", "parent").withColumnRenamed("label", "_at"))
    for direction in (d for d in directions if d in ("up", "down")):
        for _ in range(depth):
            if queue.isEmpty():
                break
            if direction == "up":
                at = queue.filter("parent <> ''").select(F.col("parent").alias("_at")).distinct()
                met = up.join(at, "_at", "left_semi").select(*(F.col(f"_{c}").alias(c) for c in slim.columns))
            else:
                met = slim.filter("parent <> ''").join(queue.select(F.col("label").alias("parent")).distinct(), "parent", "left_semi").select(*slim.columns)
            met = cut(met)
            found.append(ends(met))
            queue = cut(met.join(reduce(DataFrame.unionByName, visited), "ord", "left_anti"))
            visited = _together([*visited, queue.select("ord")])
            found = _together(found)
    return reduce(DataFrame.unionByName, found).distinct()


def traverse(graph: PGraph, start: DataFrame, directions: tuple[str, ...], depth: int) -> PGraph:
    """All nodes that the walk from start gathers, and the edges between them."""
    depth = min(depth, UNBOUNDED)
    structure = tuple(d for d in directions if d in STRUCTURE)
    ids = reach(graph.edges, start, structure, depth) if structure else start.select("id").distinct()
    if any(d in ("up", "down") for d in directions):
        ids = follow(graph.edges, ids, directions, depth)
    return induced(graph, ids)



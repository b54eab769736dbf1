"""Predicates as columns. Logic is two-valued: every leaf is true or false, never null, so `not` needs no care."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Attributes
from ..plans import query_text as q


def uses_depth(pred: object) -> bool:
    if isinstance(pred, q.Depth):
        return True
    if isinstance(pred, (q.Not, q.DependsOn)):
        return uses_depth(pred.inner)
    return isinstance(pred, q.And) and (uses_depth(pred.left) or uses_depth(pred.right))


def column_of(pred: object, kind: str, attributes: Attributes, depth: Column | None = None, depends: Column | None = None) -> Column:
    """pred over the rows of one kind of element. A predicate on the other kind is false.

    depth: the depth of an edge; without it an edge with a parent counts as 1 deep. depends: the outcome of a
    "depends on" that stands at the top; anywhere else it is false.
    """
    fits = pred.target in ("", kind)
    if isinstance(pred, q.Always):
        return F.lit(pred.value and fits)
    if isinstance(pred, q.Not):
        return ~column_of(pred.inner, kind, attributes, depth)
    if isinstance(pred, q.And):
        return column_of(pred.left, kind, attributes, depth) & column_of(pred.right, kind, attributes, depth)
    if not fits:
        return F.lit(False)
    if isinstance(pred, q.Compare):
        if kind == "node" and pred.name == "id":
            same = F.col("id").eqNullSafe(pred.value) if isinstance(pred.value, str) else F.lit(False)
            return same if pred.equal else ~same
        same = attributes.equals(pred.name, pred.value)
        return same if pred.equal else attributes.has(pred.name) & ~same
    if isinstance(pred, q.Has):
        return attributes.has(pred.name) if pred.present else ~attributes.has(pred.name)
    if isinstance(pred, q.Member):
        inside = F.coalesce(F.array_contains("sets", pred.group), F.lit(False))
        return inside if pred.inside else ~inside
    if kind == "node":
        return F.lit(False)
    if isinstance(pred, q.HasParent):
        return F.col("parent") != "" if pred.present else F.col("parent") == ""
    if isinstance(pred, q.Depth):
        deep = F.when(F.col("parent") == "", 0).otherwise(1) if depth is None else depth
        return deep == pred.depth if pred.equal else deep != pred.depth
    if isinstance(pred, q.DependsOn):
        return F.lit(False) if depends is None else depends
    raise TypeError(type(pred))

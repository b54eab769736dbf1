"""A property graph as three DataFrames, with dynamically typed attributes.

    nodes  id, parent, sets, attrs            unique by id
    edges  ord, src, dst, label, parent, scope_depth, sets, attrs   an ordered multiset
    sets   id, declared, attrs

attrs is MAP<STRING, VAL>; VAL = STRUCT<t, s, n, b> holds one of string 's', number 'n', boolean 'b', node reference
'r' and empty flag 'e', and equality of values is equality of the whole struct. A key that isn't there is absent.

A graph read from tables keeps attributes in columns of their own ("shredded", named a_<attribute>, null for absent):
filters on them reach the scan and columns that aren't used are never read, which a MAP can't offer. node_columns and
edge_columns tell which attributes are shredded and with which tag; all others are in attrs.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VAL = T.StructType([T.StructField("t", T.StringType()), T.StructField("s", T.StringType()), T.StructField("n", T.DoubleType()), T.StructField("b", T.BooleanType())])
ATTRS = T.MapType(T.StringType(), VAL)
SETS = T.ArrayType(T.StringType())
NODES = T.StructType([T.StructField("id", T.StringType()), T.StructField("attrs", ATTRS), T.StructField("sets", SETS), T.StructField("parent", T.StringType())])
EDGES = T.StructType([
    T.StructField("ord", T.LongType()), T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("parent", T.StringType()), T.StructField("scope_depth", T.IntegerType()), T.StructField("attrs", ATTRS), T.StructField("sets", SETS),
])
GROUPS = T.StructType([T.StructField("id", T.StringType()), T.StructField("attrs", ATTRS), T.StructField("declared", T.BooleanType())])
_SLOT = {"s": "s", "r": "s", "n": "n", "b": "b"}
_SQL = {"s": "string", "r": "string", "n": "double", "b": "boolean"}
PREFIX = "a_"


class NodeRef(str):
    """A value that refers to a node; it never equals a string."""


@dataclass(frozen=True)
class Empty:
    """The value of a flag: a key that is there without a value."""


EMPTY = Empty()


def pack(value: object) -> tuple:
    """A Python value as a row of VAL."""
    if isinstance(value, Empty) or value is None:
        return ("e", None, None, None)
    if isinstance(value, bool):
        return ("b", None, None, value)
    if isinstance(value, NodeRef):
        return ("r", str(value), None, None)
    if isinstance(value, str):
        return ("s", value, None, None)
    return ("n", None, float(value), None)


def unpack(row) -> object:
    t, s, n, b = row
    return {"e": EMPTY, "b": b, "r": NodeRef(s) if s is not None else None, "s": s, "n": n}[t]


def struct_of(tag: str, value: Column) -> Column:
    """A VAL column with `value` in the slot of its tag."""
    slots = {k: F.lit(None).cast(_SQL[k]) for k in "snb"}
    if tag in _SLOT:
        slots[_SLOT[tag]] = value.cast(_SQL[tag])
    return F.struct(F.lit(tag).alias("t"), *(slots[k].alias(k) for k in "snb"))


def literal(value: object) -> Column:
    tag, s, n, b = pack(value)
    return struct_of(tag, F.lit(next((x for x in (s, n, b) if x is not None), None)))


def no_attrs() -> Column:
    return F.create_map().cast(ATTRS)


def no_sets() -> Column:
    return F.array().cast(SETS)


def merged(left: Column, right: Column) -> Column:
    """Two attribute maps, the right one's values where both have a key."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


class Attributes:
    """How attributes of one kind of element are read and written, whether they are columns or in the map."""

    def __init__(self, columns: Mapping[str, str]):
        self.columns = columns

    def has(self, name: str) -> Column:
        if name in self.columns:
            return F.col(f"`{PREFIX}{name}`").isNotNull()
        return F.coalesce(F.map_contains_key("attrs", name), F.lit(False))

    def value(self, name: str) -> Column:
        if name in self.columns:
            column = F.col(f"`{PREFIX}{name}`")
            return F.when(column.isNotNull(), struct_of(self.columns[name], column))
        return F.col("attrs").getItem(name)

    def equals(self, name: str, value: object) -> Column:
        if name in self.columns:
            tag, s, n, b = pack(value)
            if tag != self.columns[name]:
                return F.lit(False)
            return F.col(f"`{PREFIX}{name}`").eqNullSafe(next(x for x in (s, n, b) if x is not None))
        return self.value(name).eqNullSafe(literal(value))


@dataclass(frozen=True)
class PGraph:
    nodes: DataFrame
    edges: DataFrame
    sets: DataFrame
    node_columns: Mapping[str, str] = field(default_factory=dict)
    edge_columns: Mapping[str, str] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_(self, **changes) -> PGraph:
        return replace(self, **changes)

    def columns_of(self, kind: str) -> Mapping[str, str]:
        return self.node_columns if kind == "node" else self.edge_columns

    def table_of(self, kind: str) -> DataFrame:
        return self.nodes if kind == "node" else self.edges

    def with_table(self, kind: str, table: DataFrame, columns: Mapping[str, str] | None = None) -> PGraph:
        columns = self.columns_of(kind) if columns is None else columns
        return self.with_(nodes=table, node_columns=columns) if kind == "node" else self.with_(edges=table, edge_columns=columns)

    def in_map(self, kind: str, names: set[str] | None = None) -> PGraph:
        """The graph with shredded attributes (all, or those named) of a kind moved into attrs."""
        columns = self.columns_of(kind)
        moved = [n for n in columns if names is None or n in names]
        if not moved:
            return self
        entries = F.array(*(F.struct(F.lit(n).alias("key"), Attributes(columns).value(n).alias("value")) for n in moved))
        own = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).cast(ATTRS)
        table = self.table_of(kind).withColumn("attrs", merged(F.coalesce("attrs", no_attrs()), own)).drop(*(PREFIX + n for n in moved))
        return self.with_table(kind, table, {n: t for n, t in columns.items() if n not in moved})

    def get(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def flat(self, kind: str, names: list[str]) -> DataFrame:
        """Elements with the named attributes as strings (numbers, booleans and strings alike; flags are null)."""
        attributes = Attributes(self.columns_of(kind))
        own = ["id"] if kind == "node" else ["src", "dst", "label", "parent"]

        def shown(name: str) -> Column:
            if name in attributes.columns:
                return F.col(f"`{PREFIX}{name}`").cast("string")
            v = attributes.value(name)
            return F.coalesce(v["s"], v["n"].cast("string"), v["b"].cast("string"))

        return self.table_of(kind).select(*own, *(shown(n).alias(n) for n in names))


def from_tables(nodes: DataFrame, edges: DataFrame, node_attrs: Mapping[str, str], edge_attrs: Mapping[str, str], sets: list[str] = ()) -> PGraph:
    """A graph over tables. nodes: id, optionally parent and sets; edges: ord, src, dst, optionally label, parent, sets.

    node_attrs and edge_attrs name the columns that are attributes, with their tags ('s', 'n' or 'b').
    """
    spark = nodes.sparkSession

    def column(df: DataFrame, name: str, default: Column) -> Column:
        return F.col(name).alias(name) if name in df.columns else default.alias(name)

    shredded = lambda attrs: [F.col(n).cast(_SQL[t]).alias(PREFIX + n) for n, t in attrs.items()]
    n = nodes.select("id", column(nodes, "parent", F.lit(None).cast("string")), column(nodes, "sets", no_sets()), no_attrs().alias("attrs"), *shredded(node_attrs))
    e = edges.select(
        "ord", "src", "dst", column(edges, "label", F.lit("")), column(edges, "parent", F.lit("")), F.lit(0).alias("scope_depth"),
        column(edges, "sets", no_sets()), no_attrs().alias("attrs"), *shredded(edge_attrs),
    )
    s = spark.createDataFrame([(x, {}, True) for x in sets], GROUPS)
    return PGraph(n, e, s, dict(node_attrs), dict(edge_attrs))

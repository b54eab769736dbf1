"""Graphs over relational tables: what contains what, and what follows what."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import PGraph, from_tables

_STRINGS = ("kind", "name", "segment", "status", "priority", "brand", "type")
NODE_ATTRS = {**dict.fromkeys(_STRINGS, "s"), "balance": "n", "size": "n"}
EDGE_ATTRS = {"rel": "s", "returnflag": "s", "quantity": "n"}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _place(level: int, value: Column) -> Column:
    """Edges of one level come before those of the next, and by value inside a level."""
    return (F.lit(level << 58) + value).cast("long")


def _item_place(items: DataFrame) -> Column:
    """Places by order, line number, and the other columns; equal rows share an order and a line number, which aren't a
    key, and get places of their own too. 38, 8 and 12 bits; what doesn't fit is an error."""
    rest = [c for c in items.columns if c not in ("l_orderkey", "l_linenumber")]
    rank = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*rest))
    fits = F.col("l_orderkey").between(0, (1 << 38) - 1) & F.col("l_linenumber").between(0, 255) & (rank < 4096)
    place = _place(3, F.shiftleft("l_orderkey", 20) + F.shiftleft(F.col("l_linenumber").cast("long"), 12) + rank)
    return F.when(fits, place).otherwise(F.raise_error(F.lit("a line item's place doesn't fit")).cast("long"))


def _nodes(df: DataFrame, prefix: str, key: str, kind: str, sets: Column | None = None, **attrs: str) -> DataFrame:
    found = {"kind": F.lit(kind), **{k: F.col(c) for k, c in attrs.items()}}
    filled = (found.get(n, F.lit(None)).cast("double" if t == "n" else "string").alias(n) for n, t in NODE_ATTRS.items())
    return df.select(_id(prefix, key).alias("id"), (F.array() if sets is None else sets).cast("array<string>").alias("sets"), *filled)


def containment(spark: SparkSession, sf_dir: str) -> PGraph:
    """region -> nation -> customer -> order -> part by line item: each edge depends on the one above it."""
    region, nation, customer, orders = (_read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    only = lambda condition, name: F.when(condition, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    nodes = [
        _nodes(region, "r_", "r_regionkey", "region", name="r_name"),
        _nodes(nation, "n_", "n_nationkey", "nation", name="n_name"),
        _nodes(customer, "c_", "c_custkey", "customer", only(F.col("c_mktsegment") == "BUILDING", "building"), name="c_name", segment="c_mktsegment", balance="c_acctbal"),
        _nodes(orders, "o_", "o_orderkey", "order", only(F.startswith("o_orderpriority", F.lit("1-")), "urgent"), status="o_orderstatus", priority="o_orderpriority"),
    ]
    none = F.lit(None)

    def edges(df: DataFrame, place: Column, src: Column, dst: Column, rel: str, label: Column, parent: Column, flag: Column = none, quantity: Column = none, sets: Column | None = None) -> DataFrame:
        sets = F.array() if sets is None else sets
        return df.select(
            place.alias("ord"), src.alias("src"), dst.alias("dst"), label.alias("label"), parent.alias("parent"), sets.cast("array<string>").alias("sets"),
            F.lit(rel).alias("rel"), flag.cast("string").alias("returnflag"), quantity.cast("double").alias("quantity"),
        )

    links = [
        edges(nation, _place(0, F.col("n_nationkey")), _id("r_", "n_regionkey"), _id("n_", "n_nationkey"), "region", _id("N_", "n_nationkey"), F.lit("")),
        edges(customer, _place(1, F.col("c_custkey")), _id("n_", "c_nationkey"), _id("c_", "c_custkey"), "nation", _id("C_", "c_custkey"), _id("N_", "c_nationkey")),
        edges(orders, _place(2, F.col("o_orderkey")), _id("c_", "o_custkey"), _id("o_", "o_orderkey"), "customer", _id("O_", "o_orderkey"), _id("C_", "o_custkey")),
    ]
    part, lineitem = _read(spark, sf_dir, "part"), _read(spark, sf_dir, "lineitem")
    nodes.append(_nodes(part, "p_", "p_partkey", "part", name="p_name", brand="p_brand", type="p_type", size="p_size"))
    returned = only(F.col("l_returnflag") == "R", "returned")
    links.append(edges(lineitem, _item_place(lineitem), _id("o_", "l_orderkey"), _id("p_", "l_partkey"), "order", F.lit(""), _id("O_", "l_orderkey"), F.col("l_returnflag"), F.col("l_quantity"), returned))
    return from_tables(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, links), NODE_ATTRS, EDGE_ATTRS, ["building", "urgent", "returned"])


def transitions(spark: SparkSession, sf_dir: str) -> PGraph:
    """A node per type of event, an edge for every two events of one user that follow each other."""
    events = _read(spark, sf_dir, "events")
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = events.select("event_id", F.col("event_type").alias("src"), following.alias("dst"), F.col("user_id").cast("string").alias("user")).filter("dst IS NOT NULL")
    nodes = events.select(F.col("event_type").alias("id")).distinct().withColumn("kind", F.lit("event"))
    return from_tables(nodes, pairs.withColumnRenamed("event_id", "ord"), {"kind": "s"}, {"user": "s"})

"""Registered queries against the SQL that must give the same rows, at the smallest size."""

import duckdb
import pytest

import __spark_entry__ as entry
from weftgraph.plans import registry, text_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


NAMES = ["subgraph_node_and", "subgraph_untargeted_edges", "type_sensitive_eq", "traverse_in_out_1", "traverse_cycle", "edge_depth_eq", "edge_depends_on", "traverse_up_1", "traverse_up_all", "traverse_down_1", "traverse_out_up", "scope_all", "collapse_segment", "collapse_nodes", "union_edges", "difference_edges", "pipeline_3stage", "simple_paths", "topo_levels", "neighbours", "adjacency", "has_cycle", "text_lines", *text_queries.oracle_sql()]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sql, name):
    got = registry.queries()[name](spark, SF)
    want = sql.sql(registry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.select(*(f'"{n}"' for n in names)).fetchall(), key=repr)


def test_all_are_registered():
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.oracle_sql()) == set(registry.queries())


def test_flagship(spark):
    found = entry.entry(spark)
    assert found.columns == ["src", "dst", "label", "parent", "rel", "returnflag"] and found.count() > 0

"""The registered graph queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PGraph
from ..operators import patterns
from ..sources.writer import lines
from . import text_queries
from .session import query
from .table_graphs import containment, transitions

#: The same graphs in SQL. N and E: containment; FN and FE: without parts and line items; T: transitions. ord is an
#: edge's place; those of a level begin at the level times 2 ** 58.
_SQL = """
WITH RECURSIVE FN AS (
  SELECT 'r_' || r_regionkey AS id, 'region' AS kind, r_name AS name, NULL::VARCHAR AS segment, NULL::VARCHAR AS status, NULL::VARCHAR AS priority, NULL::VARCHAR AS brand FROM region
  UNION ALL SELECT 'n_' || n_nationkey, 'nation', n_name, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'c_' || c_custkey, 'customer', c_name, c_mktsegment, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'o_' || o_orderkey, 'order', NULL, NULL, o_orderstatus, o_orderpriority, NULL FROM orders),
FE AS (
  SELECT 'r_' || n_regionkey AS src, 'n_' || n_nationkey AS dst, 'N_' || n_nationkey AS label, '' AS parent, 'region' AS rel, NULL::VARCHAR AS returnflag, NULL::DOUBLE AS quantity, n_nationkey::BIGINT AS ord FROM nation
  UNION ALL SELECT 'n_' || c_nationkey, 'c_' || c_custkey, 'C_' || c_custkey, 'N_' || c_nationkey, 'nation', NULL, NULL, 288230376151711744 + c_custkey FROM customer
  UNION ALL SELECT 'c_' || o_custkey, 'o_' || o_orderkey, 'O_' || o_orderkey, 'C_' || o_custkey, 'customer', NULL, NULL, 576460752303423488 + o_orderkey FROM orders),
N AS (SELECT * FROM FN UNION ALL SELECT 'p_' || p_partkey, 'part', p_name, NULL, NULL, NULL, p_brand FROM part),
E AS (SELECT * FROM FE UNION ALL SELECT 'o_' || l_orderkey, 'p_' || l_partkey, '', 'O_' || l_orderkey, 'order', l_returnflag, l_quantity,
  864691128455135232 + l_orderkey * 1048576 + l_linenumber * 4096 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) FROM lineitem),
T AS (SELECT * FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, user_id::VARCHAR AS "user" FROM events) WHERE dst IS NOT NULL)
"""

Query = Callable[[SparkSession, str], DataFrame]


def _over(text: str, out: Callable[[PGraph], DataFrame]) -> Query:
    return lambda spark, sf_dir: out(query(containment(spark, sf_dir), text))


def nodes(*names: str) -> Callable[[PGraph], DataFrame]:
    return lambda g: g.flat("node", list(names)).drop("parent")


def edges(*names: str) -> Callable[[PGraph], DataFrame]:
    return lambda g: g.flat("edge", list(names)).select("src", "dst", "label", "parent", *names)


def _ids(g: PGraph) -> DataFrame:
    return g.nodes.select("id")


def _cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges("user")(query(transitions(spark, sf_dir), 'subgraph node.kind = "event" AND node.id = "click" traverse out all'))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.topological_levels(containment(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("n"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.simple_paths(containment(spark, sf_dir), "n_3", "p_7")
    return found.select(F.array_join("path", ">").alias("path"))


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.attribute_usage(containment(spark, sf_dir))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.neighbours(containment(spark, sf_dir), "n_3")


def _adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.adjacency(containment(spark, sf_dir)).select("id", F.array_join("neighbours", ",").alias("neighbours"))


def _cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(make.__name__, patterns.has_cycle(make(spark, sf_dir))) for make in (containment, transitions)]
    return spark.createDataFrame(found, "graph string, cyclic boolean")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(query(containment(spark, sf_dir), 'subgraph node.kind != customer AND node.kind != part')).select("line")


_IN_E = "SELECT src, dst, label, parent, rel FROM {e} WHERE src IN (SELECT id FROM R) AND dst IN (SELECT id FROM R)"
_OUT_ALL = ", R AS (SELECT 'n_3' AS id UNION SELECT E.dst FROM E JOIN R ON E.src = R.id) "


def _walked(start: str, more: str = "") -> str:
    """R: what a walk up or down from S (start) gathers. M: the edges met in order, each through one before it; `more`:
    edges that the walk itself adds."""
    return (
        f", S AS ({start}), X AS MATERIALIZED (SELECT ord, src AS v FROM E UNION ALL SELECT ord, dst FROM E), L AS MATERIALIZED (SELECT ord, src, dst, label, parent FROM E), "
        "I(o) AS (SELECT ord FROM X WHERE v IN (SELECT id FROM S) UNION SELECT b.ord FROM I JOIN X a ON a.ord = I.o JOIN X b ON b.v = a.v AND b.ord > a.ord), "
        f"M AS MATERIALIZED (SELECT L.* FROM L JOIN I ON L.ord = I.o), W AS (SELECT src, dst FROM M{more}), R AS (SELECT id FROM S UNION SELECT src FROM W UNION SELECT dst FROM W) "
    )


_UP_1 = " UNION ALL SELECT src, dst FROM L WHERE label IN (SELECT parent FROM M WHERE parent <> '')"
_DOWN_1 = " UNION ALL SELECT src, dst FROM L WHERE parent IN (SELECT label FROM M WHERE label <> '')"
_KINDS = "SELECT N.id, kind FROM N JOIN R USING (id)"

_COLLAPSE = 'collapse into B where node.segment == "BUILDING"'

#: name: (query, SQL after the common part; None where SQL can't express it)
_ALL: dict[str, tuple[Query, str | None]] = {
    # extraction and predicates
    "subgraph_node_eq": (_over('subgraph node.segment == "BUILDING"', nodes("segment")), "SELECT id, segment FROM N WHERE segment = 'BUILDING'"),
    "subgraph_node_neq": (_over('subgraph node.segment != "BUILDING"', nodes("segment")), "SELECT id, segment FROM N WHERE segment <> 'BUILDING'"),
    "subgraph_node_id": (_over("subgraph node.id = c_7", nodes("name")), "SELECT id, name FROM N WHERE id = 'c_7'"),
    "subgraph_node_exists": (_over("subgraph node.brand exists", nodes("brand")), "SELECT id, brand FROM N WHERE brand IS NOT NULL"),
    "subgraph_node_not_exists": (_over("subgraph node.name not exists", nodes("kind")), "SELECT id, kind FROM N WHERE name IS NULL"),
    "subgraph_node_and": (_over('subgraph node.kind == "order" AND node.status == "F" AND node.priority != "5-LOW"', nodes("status", "priority")), "SELECT id, status, priority FROM N WHERE kind = 'order' AND status = 'F' AND priority <> '5-LOW'"),
    "subgraph_node_not": (_over('subgraph not node.segment == "BUILDING" AND node.kind exists', nodes("kind")), "SELECT id, kind FROM N WHERE NOT coalesce(segment = 'BUILDING' AND kind IS NOT NULL, false)"),
    "subgraph_node_edges": (_over('subgraph node.kind != "part"', edges("rel")), "SELECT src, dst, label, parent, rel FROM E WHERE rel <> 'order'"),
    "subgraph_edge_eq": (_over('subgraph edge.returnflag == "R"', edges("returnflag")), "SELECT src, dst, label, parent, returnflag FROM E WHERE returnflag = 'R'"),
    "subgraph_edge_neq": (_over('subgraph edge.returnflag != "R"', edges("returnflag")), "SELECT src, dst, label, parent, returnflag FROM E WHERE returnflag <> 'R'"),
    "subgraph_edge_exists": (_over("subgraph edge.returnflag exists", edges("returnflag", "quantity")), "SELECT src, dst, label, parent, returnflag, CASE WHEN quantity IS NOT NULL THEN format('{:.1f}', quantity) END AS quantity FROM E WHERE returnflag IS NOT NULL"),
    "subgraph_edge_endpoints": (_over('subgraph edge.returnflag == "R"', nodes("kind")), "SELECT id, kind FROM N WHERE id IN (SELECT src FROM E WHERE returnflag = 'R') OR id IN (SELECT dst FROM E WHERE returnflag = 'R')"),
    "subgraph_in_set": (_over("subgraph node in @urgent", nodes("priority")), "SELECT id, priority FROM N WHERE priority LIKE '1-%'"),
    "subgraph_not_in_set": (_over("subgraph node not in @urgent AND node.priority exists", nodes("priority")), "SELECT id, priority FROM N WHERE priority NOT LIKE '1-%'"),
    "subgraph_edge_in_set": (_over("subgraph edge in @returned", edges("returnflag")), "SELECT src, dst, label, parent, returnflag FROM E WHERE returnflag = 'R'"),
    "subgraph_untargeted_nodes": (_over("subgraph in urgent", _ids), "SELECT id FROM N WHERE priority LIKE '1-%'"),
    "subgraph_untargeted_edges": (_over("subgraph in returned", _ids), "SELECT id FROM N WHERE id IN (SELECT src FROM E WHERE returnflag = 'R') OR id IN (SELECT dst FROM E WHERE returnflag = 'R')"),
    "subgraph_untargeted_fallback": (_over("subgraph in missing", nodes("kind")), "SELECT id, kind FROM N"),
    "subgraph_untargeted_not_in": (_over("subgraph not in urgent", nodes("priority")), "SELECT id, priority FROM N WHERE priority IS NULL OR priority NOT LIKE '1-%'"),
    "subgraph_edge_not_in_set": (_over("subgraph edge not in @returned", edges("returnflag")), "SELECT src, dst, label, parent, returnflag FROM E WHERE returnflag IS NULL OR returnflag <> 'R'"),
    "subgraph_exists": (_over("subgraph exists", edges("rel")), "SELECT src, dst, label, parent, rel FROM E"),
    "subgraph_depth_exists": (_over("subgraph edge.depth exists", nodes("kind")), "SELECT id, kind FROM N"),
    "identity": (_over("", nodes("kind", "name")), "SELECT id, kind, name FROM N"),
    "type_sensitive_eq": (_over('make node.size = 5 where node.brand == "Brand#11" | subgraph node.size == 5', nodes("brand")), "SELECT id, brand FROM N WHERE brand = 'Brand#11'"),
    # walks over structure
    "traverse_out_2": (_over("subgraph node.id == r_1 traverse out 2", nodes("kind")), ", R AS (SELECT 'r_1' AS id UNION SELECT dst FROM E WHERE src = 'r_1' UNION SELECT b.dst FROM E a JOIN E b ON b.src = a.dst WHERE a.src = 'r_1') SELECT N.id, kind FROM N JOIN R USING (id)"),
    "traverse_in_1": (_over("subgraph node.id == p_7 traverse in 1", edges("rel")), ", R AS (SELECT 'p_7' AS id UNION SELECT src FROM E WHERE dst = 'p_7') " + _IN_E.format(e="E")),
    "traverse_both_1": (_over("subgraph node.id == c_7 traverse both 1", nodes("kind")), ", R AS (SELECT 'c_7' AS id UNION SELECT src FROM E WHERE dst = 'c_7' UNION SELECT dst FROM E WHERE src = 'c_7') SELECT N.id, kind FROM N JOIN R USING (id)"),
    "traverse_in_out_1": (_over("subgraph node.id == o_7 traverse in out 1", nodes("kind")), ", R AS (SELECT 'o_7' AS id UNION SELECT src FROM E WHERE dst = 'o_7' UNION SELECT dst FROM E WHERE src = 'o_7') SELECT N.id, kind FROM N JOIN R USING (id)"),
    "traverse_out_all": (_over("subgraph node.id == n_3 traverse out all", edges("rel")), _OUT_ALL + _IN_E.format(e="E")),
    "traverse_edge_seed": (_over('subgraph edge.returnflag == "R" traverse in 1', edges("rel")), ", S AS (SELECT src AS id FROM E WHERE returnflag = 'R' UNION SELECT dst FROM E WHERE returnflag = 'R'), R AS (SELECT id FROM S UNION SELECT src FROM E JOIN S ON E.dst = S.id) " + _IN_E.format(e="E")),
    "traverse_cycle": (_cycle, ", R AS (SELECT 'click' AS id WHERE EXISTS (SELECT 1 FROM events WHERE event_type = 'click') UNION SELECT T.dst FROM T JOIN R ON T.src = R.id) SELECT src, dst, '' AS label, '' AS parent, \"user\" FROM T WHERE src IN (SELECT id FROM R) AND dst IN (SELECT id FROM R)"),
    # edges that depend on edges
    "edge_parent_exists": (_over("subgraph edge parent exists", edges("rel")), "SELECT src, dst, label, parent, rel FROM E WHERE parent <> ''"),
    "edge_parent_not_exists": (_over("subgraph edge parent not exists", edges("rel")), "SELECT src, dst, label, parent, rel FROM E WHERE parent = ''"),
    "edge_depth_eq": (_over("subgraph edge.depth == 2", edges("rel")), "SELECT src, dst, label, parent, rel FROM E WHERE rel = 'customer'"),
    "edge_depth_neq": (_over("subgraph edge.depth != 3", edges("rel")), "SELECT src, dst, label, parent, rel FROM E WHERE rel <> 'order'"),
    "edge_depends_on": (_over('subgraph edge depends on edge.rel == "nation"', edges("rel")), "SELECT src, dst, label, parent, rel FROM E WHERE parent IN (SELECT label FROM E WHERE rel = 'nation' AND label <> '')"),
    # Before a walk up or down, edges are met in order, each through one before it.
    "traverse_up_1": (_over("subgraph node.id == o_7 traverse up 1", edges("rel")), _walked("SELECT 'o_7' AS id", _UP_1) + _IN_E.format(e="E")),
    "traverse_up_all": (_over("subgraph node.id == o_7 traverse up all", nodes("kind")), _walked("SELECT 'o_7' AS id", " UNION ALL SELECT src, dst FROM L JOIN A ON L.label = A.label").replace("W AS (", "A(label) AS (SELECT parent FROM M WHERE parent <> '' UNION SELECT L.parent FROM L JOIN A ON L.label = A.label WHERE L.parent <> ''), W AS (") + _KINDS),
    "traverse_down_1": (_over("subgraph node.id == n_3 traverse down 1", nodes("kind")), _walked("SELECT 'n_3' AS id", _DOWN_1) + _KINDS),
    "traverse_out_up": (_over("subgraph node.id == o_7 traverse out up 1", edges("rel")), _walked("SELECT 'o_7' AS id UNION SELECT dst FROM E WHERE src = 'o_7'", _UP_1) + _IN_E.format(e="E")),
    "scope_all": (_over("subgraph edge.rel == region scope", nodes("kind")), "SELECT id, kind FROM N WHERE id IN (SELECT src FROM E UNION SELECT dst FROM E)"),
    # changes
    "make_node_attr": (_over('make node.tier = gold where node.segment == "BUILDING" | make node.tier = "none" where node.tier not exists', nodes("tier")), "SELECT id, CASE WHEN segment = 'BUILDING' THEN 'gold' ELSE 'none' END AS tier FROM N"),
    "make_node_column": (_over('make node.status = "late" where node.status == "O"', nodes("status")), "SELECT id, CASE WHEN status = 'O' THEN 'late' ELSE status END AS status FROM N"),
    "make_edge_attr": (_over('make edge.back = true where edge.returnflag == "R"', edges("back")), "SELECT src, dst, label, parent, CASE WHEN returnflag = 'R' THEN 'true' END AS back FROM E"),
    "remove_edge": (_over('remove edge where edge.rel == "order"', edges("rel")), "SELECT src, dst, label, parent, rel FROM E WHERE rel <> 'order'"),
    "remove_node_attr": (_over('remove node.segment where node in @building', nodes("segment")), "SELECT id, CASE WHEN segment <> 'BUILDING' THEN segment END AS segment FROM N"),
    "remove_edge_attr": (_over('remove edge.returnflag where edge.returnflag == "N"', edges("returnflag")), "SELECT src, dst, label, parent, CASE WHEN returnflag <> 'N' THEN returnflag END AS returnflag FROM E"),
    "remove_orphans": (_over('remove edge where edge.rel == "order" | remove orphans', nodes("kind")), "SELECT id, kind FROM N WHERE id IN (SELECT src FROM FE) OR id IN (SELECT dst FROM FE)"),
    "collapse_segment": (_over(_COLLAPSE, edges("rel", "returnflag", "quantity")), ", B AS (SELECT id FROM N WHERE segment = 'BUILDING') SELECT DISTINCT CASE WHEN src IN (FROM B) THEN 'B' ELSE src END AS src, CASE WHEN dst IN (FROM B) THEN 'B' ELSE dst END AS dst, '' AS label, '' AS parent, rel, returnflag, CASE WHEN quantity IS NOT NULL THEN format('{:.1f}', quantity) END AS quantity FROM E WHERE NOT (src IN (FROM B) AND dst IN (FROM B))"),
    "collapse_nodes": (_over(_COLLAPSE, nodes("kind", "name")), "SELECT id, kind, name FROM N WHERE segment IS DISTINCT FROM 'BUILDING' UNION ALL SELECT 'B', 'customer', max_by(name, id) FROM N WHERE segment = 'BUILDING' HAVING count(*) > 0"),
    # named graphs and algebra
    "bind_from_input": (_over('subgraph node.kind = customer | (subgraph node.kind = order) as O | from O', _ids), "SELECT id FROM N WHERE kind = 'order'"),
    "bind_returns_input": (_over('subgraph node.kind = customer | (subgraph node.kind = order) as O', _ids), "SELECT id FROM N WHERE kind = 'customer'"),
    "from_reset": (_over('subgraph node.kind = customer | from * | subgraph node.kind = nation', _ids), "SELECT id FROM N WHERE kind = 'nation'"),
    "pipeline_3stage": (_over('subgraph node.kind != part | make node.seen = yes where node.kind = customer | subgraph node.seen exists traverse in 1', nodes("seen")), ", R AS (SELECT id FROM N WHERE kind = 'customer' UNION SELECT src FROM FE WHERE rel = 'nation') SELECT N.id, CASE WHEN kind = 'customer' THEN 'yes' END AS seen FROM N JOIN R USING (id)"),
    "union_nodes": (_over('(subgraph node.kind = customer) as A | (subgraph node in @building) as B | A + B', nodes("segment")), "SELECT id, segment FROM N WHERE kind = 'customer'"),
    "union_edges": (_over('(subgraph edge.rel = region) as A | (subgraph edge.rel != order) as B | A + B', edges("rel")), "SELECT src, dst, label, parent, rel FROM FE WHERE rel = 'region' UNION ALL SELECT src, dst, label, parent, rel FROM FE"),
    "intersect_nodes": (_over('(subgraph edge.rel = nation) as A | (subgraph edge.rel = customer) as B | A & B', nodes("kind")), ", X AS (SELECT * FROM E WHERE rel = 'nation'), Y AS (SELECT * FROM E WHERE rel = 'customer') SELECT id, kind FROM N WHERE id IN (SELECT src FROM X UNION SELECT dst FROM X) AND id IN (SELECT src FROM Y UNION SELECT dst FROM Y)"),
    "intersect_edges": (_over('(subgraph edge.returnflag = R) as A | A & *', edges("returnflag")), "SELECT src, dst, label, parent, returnflag FROM E WHERE returnflag = 'R'"),
    "difference_nodes": (_over('(subgraph node.kind = order) as A | * - A', nodes("kind")), "SELECT id, kind FROM N WHERE kind <> 'order'"),
    "difference_edges": (_over('(subgraph node.kind = order) as A | * - A', edges("rel")), "SELECT src, dst, label, parent, rel FROM E WHERE rel IN ('region', 'nation')"),
    "symdiff_nodes": (_over('(subgraph edge.rel = nation) as A | (subgraph edge.rel = customer) as B | A ^ B', nodes("kind")), ", X AS (SELECT * FROM E WHERE rel = 'nation'), Y AS (SELECT * FROM E WHERE rel = 'customer') SELECT id, kind FROM N WHERE (id IN (SELECT src FROM X UNION SELECT dst FROM X)) <> (id IN (SELECT src FROM Y UNION SELECT dst FROM Y))"),
    "symdiff_edges": (_over('(subgraph node.kind != region AND node.kind != nation AND node.kind != customer) as A | (subgraph node.kind != part AND node.kind != order AND node.kind != customer) as B | A ^ B', edges("rel")), "SELECT src, dst, label, parent, rel FROM E WHERE rel IN ('order', 'region')"),
    # questions
    "attr_usage": (_usage, "SELECT attribute, count(*) AS n FROM (SELECT 'kind' AS attribute FROM N UNION ALL SELECT 'name' FROM N WHERE name IS NOT NULL UNION ALL SELECT 'segment' FROM N WHERE segment IS NOT NULL UNION ALL SELECT 'status' FROM N WHERE status IS NOT NULL UNION ALL SELECT 'priority' FROM N WHERE priority IS NOT NULL UNION ALL SELECT 'brand' FROM N WHERE brand IS NOT NULL UNION ALL SELECT 'type' FROM part WHERE p_type IS NOT NULL UNION ALL SELECT 'size' FROM part WHERE p_size IS NOT NULL UNION ALL SELECT 'balance' FROM customer WHERE c_acctbal IS NOT NULL) GROUP BY attribute"),
    "topo_levels": (_levels, ", D AS (SELECT id, 0 AS level FROM N UNION SELECT E.dst, D.level + 1 FROM D JOIN E ON E.src = D.id) SELECT level, count(*) AS n FROM (SELECT id, max(level) AS level FROM D GROUP BY id) GROUP BY level"),
    "neighbours": (_neighbours, "SELECT DISTINCT dst AS id FROM E WHERE src = 'n_3'"),
    "adjacency": (_adjacency, "SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS neighbours FROM (SELECT DISTINCT src, dst FROM E) GROUP BY src"),
    "has_cycle": (_cyclic, ", Y AS (SELECT DISTINCT src, dst FROM T), Z AS (SELECT src, dst FROM Y UNION SELECT Z.src, Y.dst FROM Z JOIN Y ON Z.dst = Y.src) SELECT 'containment' AS graph, false AS cyclic UNION ALL SELECT 'transitions', EXISTS (SELECT 1 FROM Z WHERE src = dst)"),
    "text_lines": (_lines, "SELECT 'set ' || s AS line FROM (VALUES ('building'), ('urgent'), ('returned')) v(s) UNION ALL SELECT 'node ' || id || ' [kind=\"' || kind || '\"' || CASE WHEN kind = 'order' THEN ', priority=\"' || priority || '\", status=\"' || status || '\"]' || CASE WHEN priority LIKE '1-%' THEN ' @urgent' ELSE '' END ELSE ', name=\"' || name || '\"]' END FROM FN WHERE kind <> 'customer' UNION ALL SELECT label || ': ' || src || '->' || dst || ' [rel=\"region\"]' FROM FE WHERE rel = 'region'"),
    "simple_paths": (_paths, ", P AS (SELECT 'n_3' AS cur, 'n_3' AS path UNION SELECT E.dst, P.path || '>' || E.dst FROM P JOIN E ON E.src = P.cur) SELECT path FROM P WHERE cur = 'p_7'"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is sold to the customers of one market segment: filter, walk, and the edges found."""
    return edges("rel", "returnflag")(query(containment(spark, sf_dir), 'subgraph node.segment == "BUILDING" traverse out 2'))


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _ALL.items()} | text_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {name: _SQL + sql for name, (_, sql) in _ALL.items() if sql is not None} | text_queries.oracle_sql()

"""Queries on job graphs. Most graphs are small tables of fixed values; those of orders, parts and suppliers are whole tables of the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.operators import graph

from .registry import query, table

#: A job graph: id, kind, subtasks, whether it holds an instance, whom it shares an instance with.
VERTICES = [
    ("in", "input", 2, True, None), ("t1", "task", 2, True, "in"), ("t2", "task", 3, True, "t3"), ("t3", "task", 1, False, "t2"),
    ("out", "output", 2, True, None), ("out2", "output", 1, True, "out"), ("out3", "output", 4, True, None), ("lost", "task", 0, True, None),
]
#: src, out_gate, dst, in_gate, channel, pattern.
EDGES = [
    ("in", 0, "t1", 0, "NETWORK", "BIPARTITE"), ("in", 1, "t3", 0, "INMEMORY", "POINTWISE"), ("t1", 0, "out2", 0, "NETWORK", "BIPARTITE"),
    ("t1", 1, "t2", 0, "INMEMORY", "POINTWISE"), ("t1", 2, "t2", 1, "NETWORK", "BIPARTITE"), ("t2", 0, "out", 0, "INMEMORY", "POINTWISE"),
    ("t2", 1, "out3", 0, "NETWORK", "BIPARTITE"), ("t3", 0, "out", 2, "NETWORK", "POINTWISE"),
]
#: Edges that close cycles, one of them of a vertex to itself.
CYCLIC = [("a", 0, "b", 0), ("b", 0, "c", 0), ("c", 0, "a", 0), ("c", 1, "d", 0), ("d", 0, "d", 1), ("d", 1, "e", 0)]


def vertices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VERTICES, "id string, kind string, subtasks int, has_instance boolean, share_with string")


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "src string, out_gate int, dst string, in_gate int, channel string, pattern string")


def cyclic(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CYCLIC, "src string, out_gate int, dst string, in_gate int")


def _values(rows: list[tuple]) -> str:
    def one(x: object) -> str:
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


_G = f"""
WITH RECURSIVE v(id, kind, subtasks, has_instance, share_with) AS (VALUES {_values(VERTICES)}),
e(src, out_gate, dst, in_gate, channel, pattern) AS (VALUES {_values(EDGES)}),
c(src, out_gate, dst, in_gate) AS (VALUES {_values(CYCLIC)}),
"""


@query(_G + """
p AS (
  SELECT dst, 'in e(' || src || ':' || out_gate || '>' || dst || ':' || in_gate || ') ' || dst AS path FROM e WHERE src = 'in'
  UNION ALL
  SELECT e.dst, path || ' e(' || e.src || ':' || e.out_gate || '>' || e.dst || ':' || e.in_gate || ') ' || e.dst FROM p JOIN e ON e.src = p.dst WHERE p.dst <> 'out')
SELECT path, len(string_split(path, ' ')) AS n_elements FROM p WHERE dst = 'out'
""")
def enumerate_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sequences(edges(spark), "in", "out").select("path", "n_elements")


@query(_G + """
r AS (SELECT id AS node FROM v WHERE kind = 'input' UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)
SELECT id AS node FROM v WHERE id NOT IN (SELECT node FROM r)
""")
def reachable_from_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unreachable(vertices(spark), edges(spark))


@query(_G + """
r AS (SELECT src, dst FROM c UNION SELECT r.src, c.dst FROM r JOIN c ON c.src = r.dst)
SELECT DISTINCT a.src AS node FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst
""")
def cycle_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycle_vertices(cyclic(spark))


@query(_G + """
d AS (SELECT id, kind, (SELECT count(*) FROM e WHERE dst = id) AS n_in, (SELECT count(*) FROM e WHERE src = id) AS n_out FROM v)
SELECT id, kind, n_in, n_out FROM d
WHERE NOT CASE kind WHEN 'input' THEN n_out >= 1 AND n_in = 0 WHEN 'output' THEN n_in >= 1 AND n_out = 0 ELSE n_in >= 1 AND n_out >= 1 END
""")
def degree_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_offenders(vertices(spark), edges(spark))


@query(_G + """
s AS (SELECT src AS id, 'out' AS side, out_gate AS gate FROM e UNION ALL SELECT dst, 'in', in_gate FROM e)
SELECT id, side, max(gate) + 1 AS gates, count(DISTINCT gate) AS used FROM s GROUP BY id, side HAVING max(gate) + 1 <> count(DISTINCT gate)
""")
def gate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.gate_gaps(edges(spark))


@query(_G + """
r AS (SELECT id AS a, share_with AS b FROM v WHERE share_with IS NOT NULL UNION SELECT r.a, v.share_with FROM r JOIN v ON v.id = r.b WHERE v.share_with IS NOT NULL)
SELECT a AS node FROM r WHERE a = b
""")
def sharing_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sharing_cycles(vertices(spark))


_MEMBERS = _G + """
m AS (
  SELECT e.*, i.range AS i, j.range AS j FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst, range(8) i, range(8) j
  WHERE i.range < a.subtasks AND j.range < b.subtasks
    AND (pattern = 'BIPARTITE' OR CASE WHEN a.subtasks < b.subtasks THEN i.range = j.range % a.subtasks ELSE i.range % b.subtasks = j.range END))
"""


@query(_MEMBERS + """
SELECT src, out_gate, i, dst, in_gate, j, channel,
  row_number() OVER (PARTITION BY src, out_gate, i ORDER BY dst, j, in_gate) - 1 AS out_channel,
  row_number() OVER (PARTITION BY dst, in_gate, j ORDER BY src, i, out_gate) - 1 AS in_channel FROM m
""")
def subtask_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.expand(vertices(spark), edges(spark))


@query(_G + "x AS (SELECT 1) SELECT id, subtasks FROM v WHERE subtasks < 1 OR subtasks > 3")
def vertex_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vertices(spark).withColumns({"min_subtasks": F.lit(1), "max_subtasks": F.lit(3)})
    return graph.vertex_offenders(v)


@query(_G + """
u AS (SELECT src AS a, dst AS b FROM e WHERE channel = 'INMEMORY' UNION SELECT dst, src FROM e WHERE channel = 'INMEMORY'),
r AS (SELECT id AS node, id AS o FROM v UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.o)
SELECT node, min(o) AS component FROM r GROUP BY node
""")
def pipeline_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(vertices(spark).select(F.col("id").alias("node")), graph.in_memory(spark, edges(spark)))


_SUPPLY = """
WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (
  SELECT 0 AS k, node, node AS c FROM (SELECT DISTINCT a AS node FROM u)
  UNION ALL
  SELECT k + 1, node, min(c) FROM (SELECT k, node, c FROM r UNION ALL SELECT k, u.b, c FROM r JOIN u ON u.a = r.node) WHERE k < 30 GROUP BY k, node)
SELECT node, c AS component FROM r WHERE k = 30
"""


@query(_SUPPLY)
def supply_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of parts and suppliers over all line items. The SQL passes names on for 30 rounds, more than the longest
    of the shortest paths in these tables."""
    # Numbers are faster to compare than names: even ones are parts, odd ones suppliers. The least name comes at the end.
    e = table(spark, sf_dir, "lineitem").select(F.shiftleft("l_partkey", 1).alias("src"), (F.shiftleft("l_suppkey", 1) + 1).alias("dst"))
    got = graph.components(e.select(F.col("src").alias("node")).distinct().union(e.select("dst").distinct()), e)
    name = F.concat(F.when(F.col("node") % 2 == 0, "p").otherwise("s"), F.shiftright("node", 1))
    return graph.least_names(got.select(name.alias("node"), F.col("component").alias("root")))


@query(_G + """
l AS (SELECT id AS node, 0 AS level FROM v UNION SELECT e.dst, l.level + 1 FROM l JOIN e ON e.src = l.node)
SELECT node, max(level) AS level FROM l GROUP BY node
""")
def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(vertices(spark), edges(spark))


@query(_G + "x AS (SELECT 1) SELECT id, 0 AS stage FROM v")
def stage_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stage_numbers(vertices(spark))


#: A constraint along in -> t1 -> t2 -> out by the first gates of parallel edges: cid, idx, is_vertex, src, dst, out_gate, in_gate.
ELEMENTS = [
    ("c1", 0, False, "in", "t1", 0, 0), ("c1", 1, True, "t1", None, None, None), ("c1", 2, False, "t1", "t2", 1, 0),
    ("c1", 3, True, "t2", None, None, None), ("c1", 4, False, "t2", "out", 0, 0), ("c2", 0, True, "in", None, None, None), ("c2", 1, False, "in", "t3", 1, 0),
]


def elements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ELEMENTS, "cid string, idx int, is_vertex boolean, src string, dst string, out_gate int, in_gate int")


_C = _MEMBERS + f", el(cid, idx, is_vertex, src, dst, out_gate, in_gate) AS (VALUES {_values(ELEMENTS)})"


@query(_C + "SELECT cid, idx, m.src, i, m.dst, j FROM m JOIN el ON NOT is_vertex AND m.src = el.src AND m.dst = el.dst AND m.out_gate = el.out_gate AND m.in_gate = el.in_gate")
def constrained_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.constrained(graph.expand(vertices(spark), edges(spark)), elements(spark)).select("cid", "idx", "src", "i", "dst", "j")


@query(_C + """,
k AS (SELECT m.src || '#' || i AS a, m.dst || '#' || j AS b, idx FROM m JOIN el ON cid = 'c1' AND NOT is_vertex AND m.src = el.src AND m.dst = el.dst AND m.out_gate = el.out_gate AND m.in_gate = el.in_gate)
SELECT 'c1' AS cid, x.a || ' ' || x.b || ' ' || y.b || ' ' || z.b AS path FROM k x JOIN k y ON y.a = x.b AND y.idx = 2 JOIN k z ON z.a = y.b AND z.idx = 4 WHERE x.idx = 0
""")
def sequence_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.member_paths(graph.expand(vertices(spark), edges(spark)), elements(spark), "c1")


@query(_C + """,
k AS (SELECT m.src || '#' || i AS a, m.dst || '#' || j AS b FROM m JOIN el ON cid = 'c1' AND NOT is_vertex AND m.src = el.src AND m.dst = el.dst AND m.out_gate = el.out_gate AND m.in_gate = el.in_gate),
f AS (SELECT a, b FROM k WHERE a = 't1#1' UNION SELECT k.a, k.b FROM f JOIN k ON k.a = f.b),
g AS (SELECT a, b FROM k WHERE b = 't1#1' UNION SELECT k.a, k.b FROM g JOIN k ON k.b = g.a)
SELECT a AS src, b AS dst FROM f UNION SELECT a, b FROM g
""")
def anchor_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.anchored(graph.expand(vertices(spark), edges(spark)), elements(spark), "c1", F.col("node") == "t1#1")


@query(_C + "SELECT cid FROM (SELECT cid, arg_min(is_vertex, idx) AS fv, arg_min(src, idx) AS fs FROM el GROUP BY cid) JOIN v ON v.id = fs WHERE fv AND kind = 'input'")
def constraint_precondition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.invalid_constraints(elements(spark), vertices(spark))


@query(_G + """
r AS (SELECT 't2' AS node UNION SELECT e.src FROM r JOIN e ON e.dst = r.node)
SELECT node FROM r JOIN v ON v.id = node WHERE has_instance OR node = 't2'
""")
def recovery_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.recovery_closure(vertices(spark), edges(spark), spark.createDataFrame([("t2",)], "node string"))


@query(_G + "x AS (SELECT 1) SELECT id, id NOT IN (SELECT dst FROM e) AS starts, id NOT IN (SELECT src FROM e) AS ends FROM v")
def start_end_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.starts_and_ends(vertices(spark), edges(spark))


@query(_G + "x AS (SELECT 1) SELECT src, out_gate, dst, in_gate FROM e UNION SELECT src, out_gate, dst, in_gate FROM c")
def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["src", "out_gate", "dst", "in_gate"]
    return graph.merge_graphs(edges(spark).select(*keys), cyclic(spark).union(edges(spark).select(*keys)), keys)


#: Job graphs that each break one rule first, or none: vertices (id, kind, share_with), edges (src, out_gate, dst, in_gate).
SUBMITTED = {
    "fine": ([("i", "input", None), ("t", "task", None), ("o", "output", "t")], [("i", 0, "t", 0), ("t", 0, "o", 0)]),
    "gap": ([("i", "input", None), ("t", "task", None), ("o", "output", None)], [("i", 0, "t", 1), ("t", 0, "o", 0)]),
    "apart": ([("i", "input", None), ("o", "output", None), ("x", "task", None)], [("i", 0, "o", 0)]),
    "round": ([("i", "input", None), ("s", "task", None), ("t", "task", None), ("o", "output", None)], [("i", 0, "s", 0), ("s", 0, "t", 0), ("t", 0, "s", 1), ("t", 1, "o", 0)]),
    "open": ([("i", "input", None), ("t", "task", None)], [("i", 0, "t", 0)]),
    "share": ([("i", "input", "o"), ("t", "task", "i"), ("o", "output", "t")], [("i", 0, "t", 0), ("t", 0, "o", 0)]),
}
_SUBMITTED = f"""
WITH RECURSIVE v(g, id, kind, share_with) AS (VALUES {_values([(g, *v) for g, (vs, _) in SUBMITTED.items() for v in vs])}),
e(g, src, out_gate, dst, in_gate) AS (VALUES {_values([(g, *e) for g, (_, es) in SUBMITTED.items() for e in es])}),
gate AS (SELECT g, src AS id, 'out' AS side, out_gate AS gate FROM e UNION ALL SELECT g, dst, 'in', in_gate FROM e),
r AS (SELECT g, id FROM v WHERE kind = 'input' UNION SELECT e.g, e.dst FROM r JOIN e ON e.g = r.g AND e.src = r.id),
c AS (SELECT g, src AS a, dst AS b FROM e UNION SELECT c.g, c.a, e.dst FROM c JOIN e ON e.g = c.g AND e.src = c.b),
p AS (SELECT g, id AS a, share_with AS b FROM v WHERE share_with IS NOT NULL UNION SELECT p.g, p.a, v.share_with FROM p JOIN v ON v.g = p.g AND v.id = p.b WHERE v.share_with IS NOT NULL),
n AS (SELECT v.*, (SELECT count(*) FROM e WHERE e.g = v.g AND dst = id) AS n_in, (SELECT count(*) FROM e WHERE e.g = v.g AND src = id) AS n_out FROM v),
bad AS (
  SELECT g, 0 AS rule_no, 'null_edge' AS rule, id AS node FROM gate GROUP BY g, id, side HAVING max(gate) + 1 <> count(DISTINCT gate)
  UNION ALL SELECT g, 1, 'not_connected', id FROM v WHERE (g, id) NOT IN (SELECT (g, id) FROM r)
  UNION ALL SELECT c.g, 2, 'cycle', c.a FROM c JOIN c d ON c.g = d.g AND c.a = d.b AND c.b = d.a AND c.a <> c.b
  UNION ALL SELECT g, 3, 'degree', id FROM n WHERE NOT CASE kind WHEN 'input' THEN n_out >= 1 AND n_in = 0 WHEN 'output' THEN n_in >= 1 AND n_out = 0 ELSE n_in >= 1 AND n_out >= 1 END
  UNION ALL SELECT g, 4, 'sharing_cycle', a FROM p WHERE a = b)
SELECT g AS graph, rule_no, arg_min(rule, node) AS rule, min(node) AS node FROM bad b WHERE rule_no = (SELECT min(rule_no) FROM bad WHERE bad.g = b.g) GROUP BY g, rule_no
"""


@query(_SUBMITTED)
def submit_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each of some submitted graphs breaks; each rule decides once, and one graph breaks none."""
    found = []
    for name, (v, e) in SUBMITTED.items():
        vs, es = spark.createDataFrame(v, "id string, kind string, share_with string"), spark.createDataFrame(e, "src string, out_gate int, dst string, in_gate int")
        found.append(graph.submit_validation(vs, es).select(F.lit(name).alias("graph"), "rule_no", "rule", "node"))
    return reduce(DataFrame.union, found)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem),
r AS (SELECT 'c1' AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)
SELECT node FROM r
""")
def order_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a customer's vertex reaches in the graph customer -> order -> supplier."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("s"), "l_suppkey"))
    return graph.reach(o.union(li), spark.createDataFrame([("c1",)], "node string"))

"""Graphs of vertices and edges: validation, expansion, paths, components and closures."""

from __future__ import annotations

import tempfile
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .routing import wire

#: A side of a join is broadcast if it has been counted and has at most this many rows; nodes with more neighbours than
#: HOT meet them by broadcast in any case.
FEW, HOT = 200_000, 20_000


def _cut(df: DataFrame) -> DataFrame:
    """End of lineage: a checkpoint in the folder of ``spark.checkpoint.dir``. Only a local session without one, as in
    tests, gets a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def reach(edges: DataFrame, starts: DataFrame, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """(``node``): all that can be reached from ``starts``, themselves included, by rounds of joins over new nodes only."""
    steps = _cut(edges.select(F.col(src).alias("__s"), F.col(dst).alias(node)).distinct())
    seen = front = _cut(starts.select(node).distinct())
    while not front.isEmpty():
        front = _cut(front.withColumnRenamed(node, "__s").join(steps, "__s").select(node).distinct().join(seen, node, "left_anti"))
        seen = _cut(seen.union(front))
    return seen


def unreachable(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Registered vertices that no input reaches: a graph is valid if there are none."""
    return vertices.select(F.col("id").alias("node")).join(reach(edges, vertices.where("kind = 'input'").select(F.col("id").alias("node"))), "node", "left_anti")


def recovery_closure(vertices: DataFrame, edges: DataFrame, failed: DataFrame) -> DataFrame:
    """The failed vertices and all their transitive predecessors that hold an instance."""
    back = reach(edges, failed, "dst", "src")
    return back.join(vertices.where("has_instance").select(F.col("id").alias("node")), "node", "left_semi").union(failed).distinct()


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) on or between cycles: rounds take off vertices that nothing enters or nothing leaves."""
    e = _cut(edges.select("src", "dst").where("src <> dst").distinct())
    n = e.count()
    while n:
        inner = e.select(F.col("src").alias("node")).intersect(e.select("dst"))
        e = _cut(e.join(inner.select(F.col("node").alias("src")), "src", "left_semi").join(inner.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
        if (left := e.count()) == n:
            break
        n = left
    return e


def cycle_vertices(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Vertices in a strongly connected component of more than one vertex. A vertex with an edge to itself only is not
    found, as in the check that this follows.

    Vertices that can't be on a cycle are peeled off. Of what is left each vertex takes the greatest name that reaches
    it, round by round; those of one name that also reach the vertex of that name are its component. It is taken off and
    the rest is peeled again. No pairs of vertices are listed.
    """
    e, found = _peeled(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))), None
    while not e.isEmpty():
        color = _cut(e.select(F.col("src").alias("node")).distinct().withColumn("color", F.col("node")))
        while True:
            reached = e.join(color.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("c"))
            next_color = _cut(color.join(reached, "node", "left").select("node", F.greatest("color", F.coalesce("c", "color")).alias("color")))
            changed = next_color.join(color.withColumnRenamed("color", "old"), "node").where("color <> old").isEmpty()
            color = next_color
            if changed:
                break
        inside = _cut(
            e.join(color.select(F.col("node").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("b")), "dst").where("a = b").select("src", "dst")
        )
        back = reach(inside, color.where("node = color").select("node"), "dst", "src")
        whole = _cut(color.join(back, "node").withColumn("n", F.count("*").over(Window.partitionBy("color"))))
        many = whole.where("n > 1").select("node")
        found = many if found is None else found.union(many)
        gone = whole.select("node")
        e = _peeled(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    return edges.select(F.col(src).alias("node")).limit(0) if found is None else found.distinct()


def degree_offenders(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Inputs need outgoing edges only, outputs incoming ones only, tasks both."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    full = vertices.join(out, "id", "left").join(into, "id", "left").fillna(0, ["n_out", "n_in"])
    fine = F.when(F.col("kind") == "input", (F.col("n_out") >= 1) & (F.col("n_in") == 0)).when(F.col("kind") == "output", (F.col("n_in") >= 1) & (F.col("n_out") == 0)).otherwise((F.col("n_out") >= 1) & (F.col("n_in") >= 1))
    return full.where(~fine).select("id", "kind", "n_in", "n_out")


def gate_gaps(edges: DataFrame) -> DataFrame:
    """Vertices whose output or input gates are not numbered 0, 1, 2 ...: a gate without an edge."""
    sides = edges.select(F.col("src").alias("id"), F.lit("out").alias("side"), F.col("out_gate").alias("gate")).union(edges.select("dst", F.lit("in"), "in_gate"))
    return sides.groupBy("id", "side").agg((F.max("gate") + 1).alias("gates"), F.countDistinct("gate").alias("used")).where("gates <> used")


def sharing_cycles(vertices: DataFrame) -> DataFrame:
    """Vertices whose ``share_with`` pointers lead back to them: with one pointer each, what is left after vertices that
    no other points to have been peeled off. A vertex that points to itself counts."""
    e = vertices.where("share_with IS NOT NULL").select(F.col("id").alias("src"), F.col("share_with").alias("dst"))
    return _peeled(e).select(F.col("src").alias("node")).union(e.where("src = dst").select("src")).distinct()


def sequences(edges: DataFrame, begin: str, end: str, inclusive: bool = True) -> DataFrame:
    """(``path``, ``elements``): every path from ``begin`` to ``end`` in a DAG with parallel edges, which give paths of
    their own. ``elements`` names vertices and edges in turn, without the end vertices unless ``inclusive``.

    Rounds go on until no path grows. A path with more edges than there are vertices with outgoing edges has been at one
    of them twice: then a cycle can be reached and the paths have no end, which raises an error.
    """
    e = edges.select("src", "dst", F.concat_ws("", F.lit("e("), "src", F.lit(":"), "out_gate", F.lit(">"), "dst", F.lit(":"), "in_gate", F.lit(")")).alias("edge"))
    e = _cut(e)
    longest = e.where((F.col("src") != end) | (F.col("src") == begin)).select("src").distinct().count()
    front = e.where(F.col("src") == begin).select("dst", F.array(F.lit(begin), "edge", "dst").alias("path"))
    done = None
    for k in count(1):
        front = _cut(front)
        if front.isEmpty():
            break
        if k > longest:
            raise ValueError(f"a cycle can be reached from {begin}")
        found = front.where(F.col("dst") == end).select("path")
        if not found.isEmpty():
            done = found if done is None else done.union(found)
        front = front.where(F.col("dst") != end).withColumnRenamed("dst", "at").join(e, F.col("at") == F.col("src")).select("dst", F.concat("path", F.array("edge", "dst")).alias("path"))
    if done is None:
        raise ValueError(f"no path leads from {begin} to {end}")
    inner = F.col("path") if inclusive else F.slice("path", 2, F.size("path") - 2)
    return done.select(F.array_join("path", " ").alias("path"), F.array_join(inner, " ").alias("elements"), F.size(inner).alias("n_elements"))


def invalid_constraints(elements: DataFrame, vertices: DataFrame) -> DataFrame:
    """Sequences that begin with an input vertex or end with an output vertex; edges that touch them are fine."""
    ends = elements.groupBy("cid").agg(F.min_by(F.struct("is_vertex", "src"), "idx").alias("first"), F.max_by(F.struct("is_vertex", "src"), "idx").alias("last"))
    kinds = vertices.select("id", "kind")
    a = ends.join(kinds.withColumnRenamed("kind", "first_kind"), F.col("first.src") == F.col("id"), "left").drop("id")
    b = a.join(kinds.withColumnRenamed("kind", "last_kind"), F.col("last.src") == F.col("id"), "left")
    bad = (F.col("first.is_vertex") & (F.col("first_kind") == "input")) | (F.col("last.is_vertex") & (F.col("last_kind") == "output"))
    return b.where(bad).select("cid")


def expand(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Member edges with the channel's number at either end, in the order of (source, target)."""
    size = vertices.select(F.col("id"), "subtasks")
    full = edges.join(size.select(F.col("id").alias("src"), F.col("subtasks").alias("m")), "src").join(size.select(F.col("id").alias("dst"), F.col("subtasks").alias("n")), "dst")
    members = wire(full)
    out = F.row_number().over(Window.partitionBy("src", "out_gate", "i").orderBy("dst", "j", "in_gate")) - 1
    into = F.row_number().over(Window.partitionBy("dst", "in_gate", "j").orderBy("src", "i", "out_gate")) - 1
    return members.select("src", "out_gate", "i", "dst", "in_gate", "j", "channel", out.alias("out_channel"), into.alias("in_channel"))


def vertex_offenders(vertices: DataFrame) -> DataFrame:
    """Vertices whose number of subtasks is below 1 or outside of what their task allows."""
    return vertices.where((F.col("subtasks") < 1) | (F.col("subtasks") < F.coalesce("min_subtasks", F.lit(1))) | (F.col("subtasks") > F.coalesce("max_subtasks", F.lit(2**31 - 1)))).select("id", "subtasks")


def components(nodes: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(``node``, ``component``): least node that hangs together with each, through edges either way.

    Edges are first tied by their ``src``: each such node and its neighbours to the least neighbour, which leaves few edges
    of a dense graph, so give as ``src`` the side with more nodes. Then rounds of stars: each node points its larger
    neighbours to the least node it knows, then itself and its smaller neighbours; paths shrink by half, so few rounds
    serve even long ones. ``edges`` may repeat; they are read twice.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), *[F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(20,0)")) for seed in (1, 2)]).first())

    def tied(rows: DataFrame, least: DataFrame) -> DataFrame:
        """Rows (u, v) with the least node near u (cut); few nodes, or else those with many neighbours, come by broadcast."""
        if least.limit(FEW + 1).count() <= FEW:
            return rows.join(F.broadcast(least), "u")
        hot = least.where(F.col("n") > HOT)  # at most edges / HOT of them
        if hot.isEmpty():
            return rows.join(least, "u")
        return rows.join(F.broadcast(hot), "u").unionByName(rows.join(F.broadcast(hot.select("u")), "u", "left_anti").join(least, "u"))

    raw = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    first = _cut(raw.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    ends = tied(raw, first).select(F.col("v").alias("x"), "m").union(first.select("u", "m"))
    e = _cut(ends.select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v")).where("u <> v").distinct())
    now = state(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _cut(tied(both.where("v > u"), _cut(near)).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        pairs = tied(large, _cut(low)).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p"))
        e = _cut(pairs.select("p.u", "p.v").where("u <> v").distinct())
        before, now = now, state(e)
        if now == before:
            break
    return nodes.select("node").distinct().join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def least_names(nodes: DataFrame) -> DataFrame:
    """(``node``, ``component``) of (node, root): the least node with each root stands for it."""
    nodes = _cut(nodes)
    least = _cut(nodes.groupBy("root").agg(F.min("node").alias("component")))
    least = F.broadcast(least) if least.limit(FEW + 1).count() <= FEW else least
    return nodes.join(least, "root", "left").select("node", "component")


def levels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(``node``, ``level``): length of the longest path that ends in a vertex, a topological order of a DAG. A path with
    more edges than vertices that edges leave has been at one of them twice: then there is a cycle, which is an error."""
    steps = _cut(edges.select("src", "dst").distinct())
    at = _cut(vertices.select(F.col("id").alias("node"), F.lit(0).alias("level")))
    front = at
    for _ in range(steps.select("src").distinct().count() + 1):
        front = _cut(front.join(steps, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg((F.max("level") + 1).alias("level")))
        if front.isEmpty():
            return at
        at = _cut(at.union(front).groupBy("node").agg(F.max("level").alias("level")))
    raise ValueError("the graph has a cycle")


def stage_numbers(vertices: DataFrame) -> DataFrame:
    """All vertices of a job run at once: one stage."""
    return vertices.select("id", F.lit(0).alias("stage"))


def constrained(members: DataFrame, elements: DataFrame) -> DataFrame:
    """Member edges on the edges of each constraint's sequence."""
    e = elements.where("NOT is_vertex").select("cid", "idx", "src", "dst", "out_gate", "in_gate")
    return members.join(e, ["src", "dst", "out_gate", "in_gate"])


def member_paths(members: DataFrame, elements: DataFrame, cid: str) -> DataFrame:
    """(``cid``, ``path``): all paths of members along the sequence of a constraint, one join for each of its edges."""
    steps = [r["idx"] for r in elements.where((F.col("cid") == cid) & ~F.col("is_vertex")).select("idx").orderBy("idx").collect()]
    own = constrained(members, elements.where(F.col("cid") == cid))
    name = lambda v, i: F.concat_ws("#", F.col(v), F.col(i))
    paths = None
    for idx in steps:
        e = own.where(F.col("idx") == idx).select(name("src", "i").alias("a"), name("dst", "j").alias("b"))
        paths = e.select(F.col("b").alias("at"), F.array("a", "b").alias("path")) if paths is None else paths.join(e, F.col("at") == F.col("a")).select(F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path"))
    return paths.select(F.lit(cid).alias("cid"), F.array_join("path", " ").alias("path"))


def anchored(members: DataFrame, elements: DataFrame, cid: str, anchors: Column) -> DataFrame:
    """Member edges of a constraint's sequence on paths through anchor members: forward and backward from those."""
    own = _cut(constrained(members, elements.where(F.col("cid") == cid)).select(F.concat_ws("#", "src", "i").alias("src"), F.concat_ws("#", "dst", "j").alias("dst")))
    starts = own.select(F.col("src").alias("node")).union(own.select("dst")).distinct().where(anchors)
    ahead, behind = reach(own, starts), reach(own, starts, "dst", "src")
    forward = own.join(ahead, F.col("src") == F.col("node"), "left_semi")
    backward = own.join(behind, F.col("dst") == F.col("node"), "left_semi")
    return forward.union(backward).distinct()


def merge_graphs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two sets of vertices or edges by their keys; the first graph's rows stay."""
    return a.unionByName(b.join(a.select(*keys), keys, "left_anti"))


def starts_and_ends(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether a vertex begins (no incoming edge) or ends (no outgoing edge) the graph."""
    into, out = edges.select(F.col("dst").alias("id")).distinct().withColumn("__i", F.lit(True)), edges.select(F.col("src").alias("id")).distinct().withColumn("__o", F.lit(True))
    return vertices.select("id").join(into, "id", "left").join(out, "id", "left").select("id", F.col("__i").isNull().alias("starts"), F.col("__o").isNull().alias("ends"))


def submit_validation(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """First rule that a job graph breaks, in the order of submission: null edge, reachability, cycle, degrees, sharing;
    with the least vertex that breaks it. Rules after that one are not looked at."""
    rules = [
        ("null_edge", lambda: gate_gaps(edges).select(F.col("id").alias("node"))), ("not_connected", lambda: unreachable(vertices, edges)),
        ("cycle", lambda: cycle_vertices(edges)), ("degree", lambda: degree_offenders(vertices, edges).select(F.col("id").alias("node"))),
        ("sharing_cycle", lambda: sharing_cycles(vertices)),
    ]
    for k, (name, rule) in enumerate(rules):
        node = rule().agg(F.min("node")).first()[0]
        if node is not None:
            return vertices.sparkSession.createDataFrame([(k, name, node)], "rule_no int, rule string, node string")
    return vertices.select(F.lit(0).alias("rule_no"), F.lit("").alias("rule"), F.col("id").alias("node")).limit(0)


def in_memory(spark: SparkSession, edges: DataFrame) -> DataFrame:
    return edges.where("channel = 'INMEMORY'")

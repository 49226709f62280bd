"""Queries on latency constraints and what to do about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from streamloom.operators import qos
from streamloom.operators.numbering import numbered

from .registry import query, table
from .statistics import CENTS, MS, measurements

_ORDERS = "(SELECT l_orderkey AS path_id, l_linenumber AS idx, l_extendedprice / 1000.0 AS ms, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey % 4 END AS lifetime, l_partkey % 2 = 0 AS chained FROM lineitem)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as paths, their lines as elements with a latency; a path is active if all its elements are."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").alias("idx"), (F.col("l_extendedprice") / 1000.0).alias("ms"),
        qos.is_active(F.col("l_extendedprice"), F.when(F.col("l_suppkey") % 4 > 0, F.col("l_suppkey") % 4), F.col("l_partkey") % 2 == 0).alias("active"),
    )
    return li.groupBy("path_id").agg(F.min("active").alias("active"), F.transform(F.sort_array(F.collect_list(F.struct("idx", "ms"))), lambda x: x["ms"]).alias("latencies"))


@query(f"""
WITH p AS (SELECT path_id, list(ms ORDER BY idx, ms) AS l FROM {_ORDERS} GROUP BY path_id HAVING bool_and(ms IS NOT NULL AND (chained OR lifetime IS NOT NULL))),
t AS (SELECT path_id, CAST(list_reduce(list_prepend(CAST(0 AS DOUBLE), l), lambda a, x: trunc(a + x)) AS BIGINT) AS total FROM p)
SELECT path_id, total, total - 150 AS excess FROM t WHERE abs(total - 150) / 150.0 > 0.05
""")
def path_latency_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only active paths are judged: those all of whose edges have a latency and are chained or have a buffer lifetime."""
    totals = _paths(spark, sf_dir).where("active").select("path_id", qos.truncated_total(F.col("latencies")).alias("total"), F.lit(150).cast("long").alias("max_ms"))
    return qos.violations(totals, "total", "max_ms").select("path_id", "total", "excess")


@query(f"""
WITH s AS (SELECT event_id, CAST(400 + ({CENTS} * 37) % 32000 AS INT) AS size, CAST({CENTS} % 41 AS DOUBLE) AS lifetime, 1.0 + event_id % 50 AS records_s, user_id % 5 - 1 AS excess FROM events),
n AS (SELECT *, lifetime / 2 AS obl, 1 / (records_s * 1000) AS gap,
  CAST(greatest(50, floor(size * greatest(0.01, pow(0.95, lifetime / 2)))) AS INT) AS smaller, CAST(least(floor(size * 1.2), 32768) AS INT) AS larger FROM s WHERE excess > 0),
a AS (SELECT *, CASE WHEN obl > 5 AND obl > gap AND smaller < size * 0.98 THEN 'shrink' WHEN obl <= 1 AND size < 32768 AND (larger >= size + 100 OR larger = 32768) THEN 'grow' END AS action FROM n)
SELECT event_id, size, action, CASE action WHEN 'shrink' THEN smaller ELSE larger END AS new_size FROM a WHERE action IS NOT NULL
""")
def buffer_resize_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    edges = m.select("event_id", (400 + (F.col("cents") * 37) % 32000).cast("int").alias("size"), (F.col("cents") % 41).cast("double").alias("lifetime"), (1.0 + F.col("event_id") % 50).alias("records_s"), (F.col("user_id") % 5 - 1).alias("excess"))
    return qos.resize_buffers(edges, 32768).select("event_id", "size", "action", "new_size")


@query(f"""
WITH w AS (SELECT user_id, event_id, min({MS}) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS latency_ms,
  min({MS} - 1000) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS lifetime_ms FROM events),
c AS (SELECT user_id, max({MS}) - 864000000 AS changed FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT w.user_id, event_id FROM w LEFT JOIN c USING (user_id) WHERE changed IS NULL OR (latency_ms >= changed AND lifetime_ms >= changed)
""")
def freshness_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies are kept for four reports, lifetimes, which are measured a second earlier, for two; a channel's buffer was
    changed ten days before its last error. Channels without a change are fresh."""
    from streamloom.operators.numbering import over_last

    m = measurements(spark, sf_dir).withColumn("before", F.col("ms") - 1000)
    w = over_last(over_last(m, ["user_id"], "event_id", 4, {"latency_ms": F.min("ms")}), ["user_id"], "event_id", 2, {"lifetime_ms": F.min("before")})
    c = m.where("event_type = 'error'").groupBy("user_id").agg((F.max("ms") - 864_000_000).alias("changed"))
    return qos.fresh(w.join(c, "user_id", "left"), "latency_ms", "lifetime_ms", "changed").select("user_id", "event_id")


@query("""
WITH j(job, start, stop) AS (VALUES (1, 1000, 61000), (2, 7777, 95000), (3, 0, 29999))
SELECT job, CAST(unnest(range((start + 30000) // 5000 * 5000, stop + 1, 5000)) AS BIGINT) AS due_ms FROM j WHERE (start + 30000) // 5000 * 5000 <= stop
""")
def adjustment_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = spark.createDataFrame([(1, 1000, 61000), (2, 7777, 95000), (3, 0, 29999)], "job int, start long, stop long")
    return qos.adjustment_times(jobs, "start", "stop", 5000).select("job", "due_ms")


@query(f"SELECT user_id, event_id, cents, rank FROM (SELECT user_id, event_id, {CENTS} AS cents, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM events) WHERE rank <= 2")
def buffer_size_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qos.last_n(measurements(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id", "cents", "rank")


@query("""
WITH m AS (SELECT l_returnflag AS cid, l_linenumber AS vertex, count(DISTINCT l_suppkey) AS instances FROM lineitem GROUP BY ALL),
c AS (SELECT l_returnflag AS cid, l_linenumber AS vertex, count(*) AS channels FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY instances DESC, channels, vertex) AS rank FROM m JOIN c USING (cid, vertex))
SELECT cid, vertex, instances, channels FROM r WHERE rank = 1
""")
def anchor_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cid"), F.col("l_linenumber").alias("vertex"), F.col("l_suppkey").alias("instance"))
    return qos.anchor_vertices(li, li.groupBy("cid", "vertex").agg(F.count("*").alias("channels")))


@query("""
WITH p AS (SELECT l_returnflag AS cid, l_orderkey AS path_id, l_suppkey AS member FROM lineitem),
a AS (SELECT cid, path_id, member % 7 AS manager FROM p)
SELECT DISTINCT p.cid, manager, member AS element FROM p JOIN a ON a.cid = p.cid AND a.path_id = p.path_id
""")
def reporter_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cid"), F.col("l_orderkey").alias("path_id"), F.col("l_suppkey").alias("member"))
    anchors = p.select("cid", "member").distinct().withColumn("instance", F.col("member") % 7)
    return qos.reporters(p, anchors)


@query("""
WITH p AS (SELECT l_orderkey AS path_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx, l_partkey AS member, l_suppkey % 3 AS instance, l_partkey % 4 <> 0 AS one_out, l_partkey % 5 <> 0 AS one_in FROM lineitem),
s AS (SELECT *, CASE WHEN lag(instance) OVER w = instance AND one_in THEN 0 ELSE 1 END AS start FROM p WINDOW w AS (PARTITION BY path_id ORDER BY idx)),
r AS (SELECT *, sum(start) OVER (PARTITION BY path_id ORDER BY idx) AS run FROM s)
SELECT path_id, string_agg(CAST(member AS VARCHAR), ' ' ORDER BY idx) AS members, count(*) AS n FROM r GROUP BY path_id, run HAVING count(*) >= 2 AND arg_min(one_out, idx)
""")
def candidate_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path_id"), F.row_number().over(w).alias("idx"), F.col("l_partkey").alias("member"), (F.col("l_suppkey") % 3).alias("instance"), (F.col("l_partkey") % 4 != 0).alias("one_out"), (F.col("l_partkey") % 5 != 0).alias("one_in"))
    return qos.candidate_chains(p)


_CHAINS = """
WITH k AS (SELECT user_id AS worker, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, CAST(5 + event_id % 60 AS BIGINT) AS cpu FROM events),
"""


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the tasks of a chain, in their order."""
    e = numbered(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", "idx")
    return e.select(F.col("user_id").alias("worker"), F.col("idx").cast("long").alias("idx"), (5 + F.col("event_id") % 60).cast("long").alias("cpu"))


@query(_CHAINS + """
s AS (SELECT *, CAST(sum(cpu) OVER (PARTITION BY worker ORDER BY idx) AS BIGINT) AS upto FROM k),
p AS (SELECT a.worker, a.idx AS first, b.idx AS last, b.upto - a.upto + a.cpu AS cpu FROM s a JOIN s b ON a.worker = b.worker AND b.idx > a.idx AND b.idx < a.idx + 20),
r AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY cpu DESC, first, last) AS rank FROM p WHERE cpu <= 91)
SELECT worker, first, last, cpu FROM r WHERE rank = 1
""")
def chain_merge_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task takes 5 at least, so that no run of 20 tasks stays within 91."""
    return qos.best_merge(_chains(spark, sf_dir))


@query(_CHAINS + """
t AS (SELECT worker, sum(cpu) AS total, count(*) AS n FROM k GROUP BY worker HAVING sum(cpu) > 99 AND count(*) > 1),
h AS (SELECT k.worker, idx, total, n, total - sum(cpu) OVER (PARTITION BY k.worker ORDER BY idx) AS rb, total - sum(cpu) OVER (PARTITION BY k.worker ORDER BY idx DESC) AS re,
        row_number() OVER (PARTITION BY k.worker ORDER BY idx) AS kb, row_number() OVER (PARTITION BY k.worker ORDER BY idx DESC) AS ke FROM k JOIN t USING (worker)),
b AS (SELECT worker, min(kb) AS tb, arg_min(rb, kb) AS rb FROM h WHERE kb < n AND (rb < 99 OR kb = n - 1) GROUP BY worker),
e AS (SELECT worker, min(ke) AS te, arg_min(re, ke) AS re FROM h WHERE ke < n AND (re < 99 OR ke = n - 1) GROUP BY worker)
SELECT worker AS chain, CASE WHEN rb >= re THEN 'begin' ELSE 'end' END AS side, CASE WHEN rb >= re THEN tb ELSE te END AS tasks, CAST(CASE WHEN rb >= re THEN rb ELSE re END AS BIGINT) AS rest FROM b JOIN e USING (worker)
""")
def chain_split_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qos.split_points(_chains(spark, sf_dir).withColumnRenamed("worker", "chain"))

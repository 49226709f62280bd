"""Queries on events, states, archives, splits and resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.functions.time import millis
from streamloom.operators import records
from streamloom.operators import telemetry as tm

from .registry import query, table

MS = "(epoch_us(ts) // 1000)"
#: Event types of the driver's table stand for states of tasks.
STATES = {"signup": "SCHEDULED", "view": "RUNNING", "click": "FINISHING", "purchase": "FINISHED", "error": "FAILED"}
_STATE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " END"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.lit(None).cast("string")
    for k, v in STATES.items():
        state = F.when(F.col("event_type") == k, v).otherwise(state)
    return table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("state"), millis("ts").alias("ms"))


@query(f"SELECT user_id, coalesce(min(CASE WHEN event_type = 'purchase' THEN {MS} END), 0) AS first_ms FROM events GROUP BY user_id")
def first_status_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.first_status_time(states(spark, sf_dir), ["user_id"], "state", "FINISHED", F.col("ms"))


@query("""
WITH s AS (SELECT user_id, max(event_id) AS last_seq FROM events WHERE event_id < 500 GROUP BY user_id)
SELECT e.user_id, event_id FROM events e LEFT JOIN s USING (user_id) WHERE event_id > coalesce(last_seq, -1)
""")
def new_job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    return tm.new_events(e, e.where("event_id < 500").groupBy("user_id").agg(F.max("event_id").alias("last_seq")), "user_id", "event_id")


@query(f"SELECT event_id FROM events WHERE {MS} + 3600000 < (SELECT max({MS}) FROM events) - 86400000")
def event_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = states(spark, sf_dir)
    now = e.agg((F.max("ms") - 86400000).alias("now"))
    return tm.expired(e.join(F.broadcast(now), F.lit(True)), F.col("ms"), 3600000, F.col("now")).select("event_id")


@query(f"SELECT event_id, {_STATE} AS state FROM events WHERE {_STATE} IN ('FINISHED', 'CANCELED')")
def archived_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.archived_jobs(states(spark, sf_dir), "state").select("event_id", "state")


@query(f"SELECT user_id, min({MS}) AS first_archived FROM events GROUP BY user_id ORDER BY 2 DESC, 1 DESC LIMIT 20")
def archive_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.archive_last(states(spark, sf_dir), "user_id", "ms")


_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, b in tm.TRANSITIONS)


@query(f"""
WITH a(f, t) AS (VALUES {_ALLOWED}),
m AS (SELECT user_id, event_id, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY event_id) AS from_state, {_STATE} AS to_state FROM events)
SELECT user_id, event_id, from_state, to_state FROM m WHERE from_state IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE f = from_state AND t = to_state)
""")
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame(tm.TRANSITIONS, "from_state string, to_state string")
    return tm.illegal_transitions(states(spark, sf_dir), "user_id", "event_id", "state", allowed)


@query(f"""
WITH v AS (SELECT user_id, event_id % 20 AS vertex, arg_max({_STATE}, event_id) AS state FROM events GROUP BY ALL)
SELECT user_id, CASE WHEN bool_or(state = 'FAILED') THEN CASE WHEN bool_and(state IN ('FAILED', 'CANCELED', 'FINISHED')) THEN 'FAILED' ELSE 'FAILING' END
  WHEN bool_and(state = 'FINISHED') THEN 'FINISHED' WHEN bool_or(state IN ('RUNNING', 'FINISHING', 'FINISHED')) THEN 'RUNNING' ELSE 'SCHEDULED' END AS status FROM v GROUP BY user_id
""")
def terminal_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = states(spark, sf_dir).groupBy("user_id", (F.col("event_id") % 20).alias("vertex")).agg(F.max_by("state", "event_id").alias("state"))
    return tm.job_status(v, "user_id", "state")


@query("""SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS json FROM events""")
def job_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.as_json(table(spark, sf_dir, "events"), "event_id", "event_type")


@query(f"""
WITH e AS (SELECT user_id, event_id % 20 AS vertex, event_id, {_STATE} AS state, {MS} AS ms FROM events),
f AS (SELECT user_id, vertex, state, min(ms) AS ms FROM e GROUP BY ALL),
t AS (SELECT user_id, vertex, string_agg('{{"ms":' || ms || ',"state":"' || state || '"}}', ',' ORDER BY ms, state) AS times FROM f GROUP BY ALL),
l AS (SELECT user_id, vertex, arg_max(state, event_id) AS state FROM e GROUP BY ALL)
SELECT user_id AS job, '{{"job":' || user_id || ',"vertices":[' || string_agg('{{"vertex":' || vertex || ',"state":"' || state || '","times":[' || times || ']}}', ',' ORDER BY vertex) || ']}}' AS json FROM l JOIN t USING (user_id, vertex) GROUP BY user_id
""")
def job_detail_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's vertices with their states and the times of those."""
    return tm.job_detail(states(spark, sf_dir).withColumn("vertex", F.col("event_id") % 20), "user_id", "vertex", "event_id", "state", "ms")


@query("""
SELECT event_id, event_type, who FROM events JOIN (VALUES ('click', 'a'), ('click', 'b'), ('error', 'a')) s(t, who) ON t = event_type
""")
def event_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = spark.createDataFrame([("click", "a"), ("click", "b"), ("error", "a")], "event_type string, who string")
    return records.deliver(table(spark, sf_dir, "events").select("event_id", "event_type"), subs).select("event_id", "event_type", "who")


@query(f"SELECT user_id, max({MS}) AS last_ms, max({MS}) + 86400000 >= (SELECT max({MS}) FROM events) AS alive FROM events GROUP BY user_id")
def liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = states(spark, sf_dir)
    now = e.agg(F.max("ms")).first()[0]
    return tm.alive(e, "user_id", F.col("ms"), F.lit(now), 86_400_000)


#: Instance types: name, cores, units, memory in MB, disk in GB.
TYPES = [("small", 2, 2, 2048, 10), ("medium", 4, 4, 4096, 20), ("large", 8, 8, 8192, 40)]
_TYPES = "t(type, t_cores, t_units, t_memory, t_disk) AS (VALUES " + ", ".join(str(t) for t in TYPES) + ")"


def types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TYPES, "type string, t_cores int, t_units int, t_memory int, t_disk int")


@query(f"""
WITH {_TYPES}, h AS (SELECT s_suppkey AS host, 1 + s_suppkey % 9 AS cores, 1024 * (1 + s_suppkey % 8) AS memory FROM supplier),
b AS (SELECT host, arg_max(type, t_cores) AS fits FROM h LEFT JOIN t ON t_cores <= cores AND t_memory <= memory GROUP BY host)
SELECT host, CASE WHEN host = 3 THEN 'small' ELSE fits END AS type FROM b
""")
def instance_type_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    hosts = table(spark, sf_dir, "supplier").select(k.alias("host"), (1 + k % 9).alias("cores"), (1024 * (1 + k % 8)).alias("memory"))
    return tm.match_type(hosts, types(spark), spark.createDataFrame([(3, "small")], "host long, pinned string"))


@query(f"""
WITH {_TYPES} SELECT h.type AS host_type, t.type AS type, CASE WHEN h.type = t.type THEN 1 ELSE least(h.t_cores // t.t_cores, h.t_units // t.t_units, h.t_memory // t.t_memory, h.t_disk // t.t_disk) END AS times FROM t h, t
""")
def accommodation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.accommodation(types(spark))


_DEMAND = """
d AS (SELECT o_custkey % 50 AS job, CASE o_orderstatus WHEN 'F' THEN 'small' WHEN 'O' THEN 'medium' ELSE 'large' END AS type, count(DISTINCT o_orderkey % 40) AS most,
  count(DISTINCT CASE WHEN o_orderpriority LIKE '1%' THEN o_orderkey % 40 END) AS inputs FROM orders GROUP BY ALL)
"""


def _demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("job"), F.when(F.col("o_orderstatus") == "F", "small").when(F.col("o_orderstatus") == "O", "medium").otherwise("large").alias("type"), (F.col("o_orderkey") % 40).alias("instance"), F.col("o_orderpriority").like("1%").alias("is_input"))
    return tm.demand(o, ["job", "type"], "instance", F.col("is_input"))


@query("WITH " + _DEMAND + "SELECT job, type, most, CASE WHEN inputs = 0 THEN most ELSE inputs END AS least FROM d")
def instance_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demand(spark, sf_dir)


@query("WITH " + _DEMAND + """, a(type, n) AS (VALUES ('small', 20), ('medium', -1))
SELECT job, NOT bool_or(coalesce(n, 0) <> -1 AND CASE WHEN inputs = 0 THEN most ELSE inputs END > coalesce(n, 0)) AS admitted FROM d LEFT JOIN a USING (type) GROUP BY job
""")
def admission_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.admitted(_demand(spark, sf_dir), spark.createDataFrame([("small", 20), ("medium", -1)], "type string, n_available long"))


_NEAR = """
WITH s AS (SELECT DISTINCT l_partkey AS split, l_suppkey AS host FROM lineitem),
d AS (SELECT n_nationkey AS instance, s_suppkey AS host, CASE WHEN s_nationkey = n_nationkey THEN 2 ELSE 4 END AS distance FROM nation, supplier),
f AS (SELECT d.instance, split, min(distance) AS distance FROM s JOIN d USING (host) GROUP BY ALL)
SELECT instance, split, distance, CAST(row_number() OVER (PARTITION BY instance ORDER BY distance, split) AS INT) AS rank FROM f
"""


@query(_NEAR)
def nearest_split_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as splits on their suppliers' hosts, nations as instances: 25 rows, each with each host."""
    splits = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("split"), F.col("l_suppkey").alias("host"))
    n = table(spark, sf_dir, "nation")
    d = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.lit(True)).select(F.col("n_nationkey").alias("instance"), F.col("s_suppkey").alias("host"), F.when(F.col("s_nationkey") == F.col("n_nationkey"), 2).otherwise(4).alias("distance"))
    return tm.nearest_splits(splits, d)


@query()
def nearest_split_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations claim suppliers as splits, the nearest by the difference of nations first, until all are claimed."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("instance"))
    near = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.lit(True))
    return tm.claimed_splits(near.select("instance", F.col("s_suppkey").alias("split"), F.abs(F.col("instance") - F.col("s_nationkey")).alias("distance")))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place, l_partkey, l_suppkey FROM lineitem")
def fifo_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every split in the queue."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return tm.fifo_splits(li, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""
WITH RECURSIVE q AS (SELECT o_custkey % 100 AS instance, o_orderkey, 1 + o_orderkey % 3 AS cores, 1 + o_orderkey % 4 AS units, 256 * (1 + o_orderkey % 5) AS memory, 1 + o_orderkey % 2 AS disk,
  row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS k FROM orders),
r AS (
  SELECT instance, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS o_orderkey, CAST(64 AS BIGINT) AS c, CAST(80 AS BIGINT) AS u, CAST(16384 AS BIGINT) AS m, CAST(40 AS BIGINT) AS d, false AS granted FROM (SELECT DISTINCT instance FROM q)
  UNION ALL
  SELECT q.instance, q.k, q.o_orderkey, CASE WHEN fits THEN c - cores ELSE c END, CASE WHEN fits THEN u - units ELSE u END, CASE WHEN fits THEN m - memory ELSE m END, CASE WHEN fits THEN d - disk ELSE d END, fits
  FROM (SELECT q.*, r.c, r.u, r.m, r.d, cores <= c AND units <= u AND memory <= m AND disk <= d AS fits FROM r JOIN q ON q.instance = r.instance AND q.k = r.k + 1) q)
SELECT instance, o_orderkey, granted FROM r WHERE k > 0
""")
def slice_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of cores, units, memory and disk."""
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("instance"), "o_orderkey", (1 + k % 3).alias("cores"), (1 + k % 4).alias("units"), (256 * (1 + k % 5)).alias("memory"), (1 + k % 2).alias("disk"))
    return tm.pack_slices(r, "instance", "o_orderkey", {"cores": 64, "units": 80, "memory": 16384, "disk": 40}).select("instance", "o_orderkey", "granted")

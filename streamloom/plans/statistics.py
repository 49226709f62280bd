"""Queries on statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from streamloom.functions.time import align, millis
from streamloom.operators import qos, records, stats

from .registry import query, table

MS = "(epoch_us(ts) // 1000)"
CENTS = "CAST(round(value * 100) AS BIGINT)"


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measurements: channel, number, whole hundredths of the value, time."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), millis("ts").alias("ms"))


_W = "OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"


@query(f"""
WITH w AS (SELECT event_id, list_sort(list({CENTS}) {_W}) AS l FROM events)
SELECT event_id, l[len(l) // 2 + 1] AS w_median FROM w
""")
def rolling_median_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_window(measurements(spark, sf_dir), ["user_id"], "event_id", "cents", 4).select("event_id", "w_median")


@query(f"SELECT event_id, min({CENTS}) {_W} AS w_min, max({CENTS}) {_W} AS w_max, CAST(sum({CENTS}) {_W} AS BIGINT) AS w_sum, count(*) {_W} AS w_count FROM events")
def rolling_min_max_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_window(measurements(spark, sf_dir), ["user_id"], "event_id", "cents", 4).select("event_id", "w_min", "w_max", "w_sum", "w_count")


@query(f"SELECT event_id, first_value({CENTS}) {_W} AS w_oldest, last_value({CENTS}) {_W} AS w_newest FROM events")
def rolling_oldest_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_window(measurements(spark, sf_dir), ["user_id"], "event_id", "cents", 4).select("event_id", "w_oldest", "w_newest")


@query(f"""
WITH s AS (SELECT user_id, event_id, ts, max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events)
SELECT user_id, event_id FROM s WHERE event_id <= m
""")
def stale_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("arrival"))
    return stats.stale_values(e, ["user_id"], "arrival", "event_id").select("user_id", "event_id")


_TAGGED = f"""
WITH tagged AS (
  SELECT user_id, event_id, {MS} AS ms, {CENTS} AS cents, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
lat AS (
  SELECT user_id, ms - ms % 1000 AS bucket, count(*) AS n, CAST(sum(cents) // count(*) AS BIGINT) AS latency FROM tagged WHERE n % 7 = 0 GROUP BY ALL)
"""


def tagged_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = records.tag_every(measurements(spark, sf_dir), ["user_id"], "event_id", F.col("ms")).where("tag_ts_ms IS NOT NULL")
    return stats.edge_latency(tagged, ["user_id"], align(F.col("ms"), 1000), F.col("cents"))


@query(_TAGGED + "SELECT user_id, bucket, n, latency FROM lat")
def edge_latency_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged_latency(spark, sf_dir)


@query(_TAGGED + """,
rolled AS (SELECT user_id, bucket, latency, CAST(sum(latency) OVER w AS BIGINT) // count(*) OVER w AS mean FROM lat
           WINDOW w AS (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT user_id, bucket, latency, mean, abs(mean - 5000) * 20 > 5000 AS violated, mean - 5000 AS excess FROM rolled
""")
def flagship_edge_latency_qos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 7th record of a channel is tagged; latency by interval, mean of the last four, and whether it is off 50."""
    rolled = stats.count_window(tagged_latency(spark, sf_dir), ["user_id"], "bucket", "latency", 4).withColumn("mean", F.expr("w_sum div w_count"))
    off = F.col("mean") - 5000
    return rolled.select("user_id", "bucket", "latency", "mean", (F.abs(off) * 20 > 5000).alias("violated"), off.alias("excess"))


@query("""
WITH b AS (SELECT l_suppkey, (l_orderkey * 1000) // 60000 AS bucket, sum(CAST(round(l_extendedprice) AS BIGINT)) AS bytes, count(*) AS buffers, sum(CAST(l_quantity AS BIGINT)) AS records FROM lineitem GROUP BY ALL)
SELECT l_suppkey, bucket, round(bytes * 8 / (1e6 * 60.0), 6) AS mbit_s, CAST(60000 // buffers AS BIGINT) AS lifetime_ms,
  round(records / buffers, 6) AS records_per_buffer, round(records / 60.0, 6) AS records_s FROM b WHERE records > 0
""")
def edge_statistics_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 1000).alias("ms"), F.round("l_extendedprice").cast("long").alias("bytes"), F.col("l_quantity").cast("long").alias("records"))
    out = stats.edge_statistics(sent, ["l_suppkey"], 60_000, "ms", "bytes", "records")
    return out.select("l_suppkey", "bucket", F.round("mbit_s", 6).alias("mbit_s"), "lifetime_ms", F.round("records_per_buffer", 6).alias("records_per_buffer"), F.round("records_s", 6).alias("records_s"))


@query(f"""
WITH e AS (SELECT user_id, {MS} AS ms, {MS} // 3600000 AS bucket, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS received, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS emitted FROM events),
g AS (SELECT user_id, bucket, min(CASE WHEN received > 0 THEN ms END) AS a, max(CASE WHEN emitted > 0 THEN ms END) AS b, sum(received) AS r, sum(emitted) AS m FROM e GROUP BY ALL)
SELECT user_id, bucket, CAST((b - a) // r AS BIGINT) AS latency FROM g WHERE r >= 1 AND m >= 1 AND b >= a
""")
def vertex_latency_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = measurements(spark, sf_dir).select("user_id", "ms", F.expr("ms div 3600000").alias("bucket"), F.col("event_type").isin("view", "click").cast("int").alias("received"), (F.col("event_type") == "purchase").cast("int").alias("emitted"))
    return stats.vertex_latency(e, ["user_id"], "bucket", "ms", "received", "emitted").select("user_id", "bucket", "latency")


@query(f"""
WITH e AS (SELECT user_id, event_id, {MS} AS ms, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS received, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS emitted FROM events),
u AS (SELECT *, sum(emitted) OVER (PARTITION BY user_id ORDER BY event_id) AS upto FROM e),
p AS (SELECT *, (upto - emitted) // 3 AS period FROM u),
g AS (SELECT user_id, period, min(CASE WHEN received > 0 THEN ms END) AS first_in, max(CASE WHEN emitted > 0 THEN upto END) AS n, arg_max(ms, CASE WHEN emitted > 0 THEN upto END) AS t, CAST(sum(received) AS BIGINT) AS received FROM p GROUP BY ALL)
SELECT user_id, t AS at_ms, received, CAST((t - first_in) // received AS BIGINT) AS latency FROM g WHERE n = (period + 1) * 3 AND received > 0 AND t >= first_in
""")
def vertex_latency_by_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = measurements(spark, sf_dir).select("user_id", "event_id", "ms", F.col("event_type").isin("view", "click").cast("int").alias("received"), (F.col("event_type") == "purchase").cast("int").alias("emitted"))
    return stats.latency_by_emissions(e, "user_id", "event_id", "ms", "received", "emitted", 3)


@query(f"""
WITH own AS (SELECT event_type, user_id % 10 AS reporter, avg({CENTS}) AS mean FROM events GROUP BY ALL)
SELECT event_type, round(avg(mean), 4) AS mean, count(*) AS reports FROM own GROUP BY event_type
""")
def report_merge_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reporter's mean counts once, however many values are behind it."""
    m = measurements(spark, sf_dir).withColumn("reporter", F.col("user_id") % 10)
    return stats.merged_mean(m, ["event_type"], "reporter", F.col("cents")).withColumn("mean", F.round("mean", 4))


@query(f"SELECT user_id, arg_max({CENTS}, event_id) AS cents, arg_max({MS}, event_id) AS ms FROM events GROUP BY user_id")
def report_stats_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.last_report(measurements(spark, sf_dir), ["user_id"], "event_id", "cents", "ms")


@query(f"""
WITH e AS (SELECT event_type, {MS} // 86400000 AS day, {CENTS} AS cents FROM events),
p AS (SELECT event_type, day, cents % 777 AS a, cents // 10 AS b FROM e WHERE cents % 100 = 7),
i AS (SELECT * FROM (SELECT DISTINCT event_type FROM e), (SELECT DISTINCT day FROM e))
SELECT i.event_type, i.day, count(a) AS paths, round(coalesce(avg(a + b), 0), 4) AS avg_ms, coalesce(min(a + b), 0) AS min_ms, coalesce(max(a + b), 0) AS max_ms, round(avg(a), 4) AS first_ms, round(avg(b), 4) AS second_ms
FROM i LEFT JOIN p ON p.event_type = i.event_type AND p.day = i.day GROUP BY i.event_type, i.day
""")
def path_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of two elements by type and day; days on which a type has no active path get zeros."""
    m = measurements(spark, sf_dir).withColumn("day", F.expr("ms div 86400000"))
    intervals = m.select("event_type").distinct().crossJoin(F.broadcast(m.select("day").distinct()))  # a few types, each with each day
    paths = m.where("cents % 100 = 7").select("event_type", "day", F.array(F.col("cents") % 777, F.expr("cents div 10")).alias("latencies"))
    out = stats.path_summary(paths, ["event_type", "day"], "latencies", intervals)
    mean = lambda i: F.round(F.get("elements", F.lit(i)), 4)
    return out.select("event_type", "day", "paths", F.round("avg_ms", 4).alias("avg_ms"), "min_ms", "max_ms", mean(0).alias("first_ms"), mean(1).alias("second_ms"))


@query(f"SELECT event_id, {CENTS} / 200.0 AS waiting, greatest(0.0, {CENTS} % 777 - {CENTS} / 200.0) AS transport FROM events")
def edge_latency_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting, transport = stats.split_edge_latency((F.col("cents") % 777).cast("double"), F.col("cents") / 100)
    return measurements(spark, sf_dir).select("event_id", waiting.alias("waiting"), transport.alias("transport"))


_ROUNDS = """
WITH c AS (SELECT l_suppkey AS instance, l_orderkey // 500 AS round, sum(CAST(l_quantity AS BIGINT)) AS usr, sum(CAST(l_linenumber AS BIGINT)) AS sys, count(*) AS idle FROM lineitem GROUP BY ALL),
"""


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("instance"), F.expr("l_orderkey div 500").alias("round"), F.col("l_quantity").cast("long").alias("q"), F.col("l_linenumber").cast("long").alias("n"))
    return stats.in_parts(li, "instance", "round").groupBy("instance", "round").agg(F.sum("q").alias("usr"), F.sum("n").alias("sys"), F.count("*").alias("idle"))


@query(_ROUNDS + """
d AS (SELECT instance, round, usr - lag(usr) OVER w AS du, sys - lag(sys) OVER w AS ds, idle - lag(idle) OVER w AS di FROM c WINDOW w AS (PARTITION BY instance ORDER BY round))
SELECT instance, round, CAST(CASE WHEN du + ds + di = 0 THEN du ELSE trunc(du * 100.0 / (du + ds + di)) END AS BIGINT) AS p_usr,
  CAST(CASE WHEN du + ds + di = 0 THEN ds ELSE trunc(ds * 100.0 / (du + ds + di)) END AS BIGINT) AS p_sys FROM d WHERE du IS NOT NULL
""")
def cpu_delta_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counter_shares(_rounds(spark, sf_dir), "instance", "round", ["usr", "sys", "idle"]).select("instance", "round", "p_usr", "p_sys")


@query("""
WITH t AS (SELECT user_id AS task, event_type AS thread, epoch_us(ts) // 86400000000 AS day, count(*) AS usr, CAST(sum(event_id % 5) AS BIGINT) AS sys FROM events GROUP BY ALL),
d AS (SELECT task, thread, day, abs(usr - lag(usr) OVER w) AS du, abs(sys - lag(sys) OVER w) AS ds, (day - lag(day) OVER w) * 10 AS dc FROM t WINDOW w AS (PARTITION BY task, thread ORDER BY day)),
p AS (SELECT task, day, trunc(du * 100.0 / dc) AS pu, trunc(ds * 100.0 / dc) AS ps FROM d WHERE dc > 0)
SELECT task, day, count(*) AS threads, CAST(trunc(sum(pu) / count(*)) AS BIGINT) AS p_usr, CAST(trunc(sum(ps) / count(*)) AS BIGINT) AS p_sys FROM p GROUP BY ALL
""")
def thread_cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.col("event_type").alias("thread"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 86400000000").alias("day"), (F.col("event_id") % 5).alias("s"))
    t = e.groupBy("task", "thread", "day").agg(F.count("*").alias("usr"), F.sum("s").alias("sys")).withColumn("clock", F.col("day") * 10)
    # A clock's readings never fall: they are sums of the changes up to each day.
    w = Window.partitionBy("task", "thread").orderBy("day")
    steps = t.withColumns({f"s_{c}": F.abs(F.col(c) - F.lag(c).over(w)) for c in ("usr", "sys")})
    readings = steps.withColumns({c: F.sum(F.coalesce(f"s_{c}", F.lit(0))).over(w) for c in ("usr", "sys")})
    return stats.thread_shares(readings, "task", "thread", "day", ["usr", "sys"], "clock").select("task", "day", "threads", "p_usr", "p_sys")


@query(_ROUNDS + """
n AS (SELECT count(DISTINCT instance) AS n FROM c)
SELECT round, count(DISTINCT instance) AS instances, CAST(sum(usr) // count(*) AS BIGINT) AS usr, CAST(sum(sys) // count(*) AS BIGINT) AS sys FROM c GROUP BY round HAVING count(DISTINCT instance) * 2 >= (SELECT n FROM n)
""")
def cluster_summary_int_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds in which at least half of all instances have reported."""
    n = table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_suppkey").alias("n")).first()["n"]
    return stats.cluster_summary(_rounds(spark, sf_dir), "round", "instance", ["usr", "sys"], -(-n // 2))


@query(f"SELECT event_id, round(avg({CENTS} * 2) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS load_mean FROM events")
def task_cpu_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.nested_load(measurements(spark, sf_dir), "user_id", "event_id", F.col("cents") * 2).select("event_id", F.round("load_mean", 4).alias("load_mean"))


@query("SELECT user_id, count(*) AS records, count(*) // 8 AS full_buffers, count(*) % 8 AS rest_records FROM events GROUP BY user_id")
def fixed_size_buffering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.fixed_buffers(table(spark, sf_dir, "events"), ["user_id"], 128, 1024)


@query("""
WITH RECURSIVE d AS (SELECT source, doc_id, strlen(text) + 4 AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f AS (
  SELECT source, doc_id, k, CAST(b AS BIGINT) AS held, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS buffer FROM d WHERE k = 1
  UNION ALL
  SELECT d.source, d.doc_id, d.k, CASE WHEN f.held >= 8192 THEN d.b ELSE f.held + d.b END, CASE WHEN f.held >= 8192 THEN 1 ELSE f.n + 1 END, CASE WHEN f.held >= 8192 THEN f.buffer + 1 ELSE f.buffer END
  FROM f JOIN d ON d.source = f.source AND d.k = f.k + 1)
SELECT source, CAST(buffer AS INT) AS buffer, max(doc_id) AS last_seq, max(held) AS bytes, max(n) AS records FROM f GROUP BY source, buffer
""")
def adaptive_buffering_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").alias("size"))
    return stats.adaptive_buffers(d, "source", "doc_id", "size", 8192)


@query(f"SELECT event_id, {MS} - {MS} % 5000 AS aligned FROM events")
def time_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements(spark, sf_dir).select("event_id", align(F.col("ms"), 5000).alias("aligned"))


@query(f"""
WITH m AS (SELECT user_id, event_id, {CENTS} AS latency, CASE WHEN user_id % 3 = 0 THEN 0 ELSE {CENTS} % 41 END AS lifetime, {CENTS} % 100 AS mbit, CASE WHEN event_type <> 'error' THEN event_id % 7 END AS per_buffer, CASE WHEN user_id % 5 > 0 THEN event_id % 50 END AS per_second FROM events),
r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, avg(latency) OVER w AS l, avg(lifetime) OVER w AS t, avg(mbit) OVER w AS b, avg(per_buffer) OVER w AS p, avg(per_second) OVER w AS s FROM m
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT user_id, round(coalesce(l, -1), 4) AS mean_latency, round(coalesce(t, -1), 4) AS mean_lifetime, round(coalesce(b, -1), 4) AS mean_mbit, round(coalesce(p, -1), 4) AS mean_per_buffer, round(coalesce(s, -1), 4) AS mean_per_second FROM r WHERE n = 1
""")
def qos_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five measures of an edge over its last four reports; a chained edge has no buffer, so its lifetime is 0."""
    m, e = measurements(spark, sf_dir), F.col("event_id")
    lifetime = qos.buffer_lifetime(F.col("cents") % 41, F.col("user_id") % 3 == 0)
    own = m.select("user_id", "event_id", F.col("cents").alias("latency"), lifetime.alias("lifetime"), (F.col("cents") % 100).alias("mbit"), F.when(F.col("event_type") != "error", e % 7).alias("per_buffer"), F.when(F.col("user_id") % 5 > 0, e % 50).alias("per_second"))
    values = ["latency", "lifetime", "mbit", "per_buffer", "per_second"]
    return qos.latest_state(own, "user_id", "event_id", values).select("user_id", *[F.round(f"mean_{v}", 4).alias(f"mean_{v}") for v in values])


@query(f"""
WITH a AS (SELECT c_custkey AS user_id, c_nationkey AS model, 1700000000000 + c_custkey * 1000 AS at FROM customer WHERE c_custkey % 4 > 0),
s AS (SELECT n_nationkey AS model, count(*) FILTER (c_custkey % 4 > 0) AS have, count(*) AS members, max(1700000000000 + c_custkey * 1000) FILTER (c_custkey % 4 > 0) AS last FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND (c_custkey % 4 > 0 OR n_nationkey % 2 = 0) GROUP BY ALL),
t AS (SELECT model, CASE WHEN have = 0 THEN 'EMPTY' WHEN have < members THEN 'SHALLOW' ELSE 'READY' END AS state, last FROM s)
SELECT event_id, t.model, state FROM events JOIN a USING (user_id) JOIN t USING (model) WHERE state = 'READY' AND {MS} >= last
""")
def ready_model_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are members of their nation's model, and announce themselves unless their number is divisible by 4; of
    odd nations only those who announce themselves are expected, so that only their models become ready."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("model"))
    expected = c.where("user_id % 4 > 0 OR model % 2 = 0")
    announced = c.where("user_id % 4 > 0").withColumn("ms", 1_700_000_000_000 + F.col("user_id") * 1000)
    state = qos.model_states(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("model")), expected, announced, "model", "user_id", "ms")
    return qos.ready_measurements(measurements(spark, sf_dir), announced.select("user_id", "model"), state, "user_id", "model", "ms").select("event_id", "model", "state")

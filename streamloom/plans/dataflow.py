"""Queries on sources, sinks, per-record operators, routing and text functions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.functions import text as tx
from streamloom.functions.time import millis
from streamloom.operators import records, routing
from streamloom.sources import lines

from .registry import query, table

MS = "(epoch_us(ts) // 1000)"
#: Folders that files of documents are dealt to.
FOLDERS = 1024


@query("SELECT event_id, user_id, event_type, value FROM events")
def forward_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.forward(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"))


@query("SELECT event_id, event_type FROM events")
def grep_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.grep(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "err")


@query("SELECT event_id, event_type FROM events WHERE contains(event_type, 'err')")
def grep_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.grep(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "err", strict=False)


@query("SELECT event_id, upper(event_type) || ':' || CAST(user_id AS VARCHAR) AS label FROM events WHERE value > 10")
def chained_mappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.chain(
        table(spark, sf_dir, "events"),
        lambda d: d.where("value > 10"),
        lambda d: d.withColumn("event_type", F.upper("event_type")),
        lambda d: d.select("event_id", F.concat_ws(":", "event_type", "user_id").alias("label")),
    )


@query("""
WITH pieces AS (
  SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
trimmed AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM pieces),
numbered AS (SELECT doc_id, unnest(p) AS value, unnest(range(len(p))) AS line_no FROM trimmed)
SELECT doc_id, line_no, CASE WHEN ends_with(value, chr(13)) THEN left(value, length(value) - 1) ELSE value END AS value FROM numbered
""")
def line_source_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.explode_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query("SELECT range AS id, 'Record ' || range || ' of producer' AS value FROM range(100000)")
def counting_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.counting_records(spark, 100_000, "producer")


@query("SELECT range AS id, 128 AS bytes, range % 128 AS place, range % 128 AS byte FROM range(20000)")
def fixed_size_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.fixed_size_records(spark, 20_000).withColumn("place", F.col("id") % 128)
    byte = F.conv(F.hex(F.substring(F.col("payload"), F.col("place").cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return made.select("id", F.octet_length("payload").alias("bytes"), "place", byte.alias("byte"))


@query(f"""
WITH marks AS (SELECT event_id, {MS} AS ts_ms FROM events WHERE event_id % 100 = 0)
SELECT e.event_id, m.ts_ms FROM events e JOIN marks m ON m.event_id = e.event_id - e.event_id % 100
""")
def stamped_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.stamped_records(table(spark, sf_dir, "events"), "event_id", millis("ts"), every=100).select("event_id", "ts_ms")


@query("""
WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS pos, {ms} AS sent FROM events)
SELECT event_id, pos, sent + 25 + event_id % 7 - sent AS latency_ms FROM n WHERE (pos - 1) % 1000 = 0
""".format(ms=MS))
def sampled_latency_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", millis("ts").alias("sent")).withColumn("now", F.col("sent") + 25 + F.col("event_id") % 7)
    return records.sampled_latency(e, "event_id", "sent", "now", 1000).select("event_id", "pos", "latency_ms")


@query("SELECT event_id, pos FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS pos FROM events) WHERE pos % 1000 = 999")
def event_every_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.event_positions(table(spark, sf_dir, "events").select("event_id"), "event_id")


@query(f"""
SELECT user_id, event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 7 = 0 THEN {MS} END AS tag_ts_ms FROM events
""")
def record_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", millis("ts").alias("ms"))
    return records.tag_every(e, ["user_id"], "event_id", F.col("ms")).select("user_id", "event_id", "tag_ts_ms")


@query("SELECT event_id, gate FROM events, (VALUES (0), (1)) g(gate)")
def double_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.fan_out(table(spark, sf_dir, "events").select("event_id"))


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 4 AS INT) AS channel FROM events")
def round_robin_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.round_robin(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 4)


@query("""
WITH c AS (SELECT event_id, unnest(CASE event_type WHEN 'click' THEN [0, 1] WHEN 'error' THEN [2, 9] WHEN 'view' THEN NULL ELSE [CAST(event_id % 4 AS INT)] END) AS channel FROM events)
SELECT event_id, channel FROM c WHERE channel BETWEEN 0 AND 3
""")
def selector_multicast(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.when(F.col("event_type") == "click", F.array(F.lit(0), F.lit(1))).when(F.col("event_type") == "error", F.array(F.lit(2), F.lit(9))).when(F.col("event_type") != "view", F.array((F.col("event_id") % 4).cast("int")))
    return routing.select_channels(table(spark, sf_dir, "events").select("event_id", "event_type"), pick, 4).select("event_id", "channel")


@query("SELECT event_id, consumer FROM events, (SELECT unnest(range(2)) AS consumer)")
def broadcast_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.broadcast_to(table(spark, sf_dir, "events").select("event_id"), 2)


def _patterns(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.createDataFrame([("a", "b", 3, 5), ("b", "c", 5, 3), ("c", "d", 4, 4), ("d", "e", 1, 6)], "src string, dst string, m int, n int").withColumn("pattern", F.lit(pattern))


_WIRED = """
WITH e(src, dst, m, n) AS (VALUES ('a', 'b', 3, 5), ('b', 'c', 5, 3), ('c', 'd', 4, 4), ('d', 'e', 1, 6)),
p AS (SELECT src, dst, m, n, i.range AS i, j.range AS j FROM e, range(6) i, range(6) j WHERE i.range < m AND j.range < n)
SELECT src, dst, i, j FROM p WHERE {}
"""


@query(_WIRED.format("true"))
def bipartite_wiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.wire(_patterns(spark, "BIPARTITE")).select("src", "dst", "i", "j")


@query(_WIRED.format("CASE WHEN m < n THEN i = j % m ELSE i % n = j END"))
def pointwise_wiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.wire(_patterns(spark, "POINTWISE")).select("src", "dst", "i", "j")


@query("SELECT event_id AS id, 'event' AS kind FROM events UNION ALL SELECT o_orderkey, 'order' FROM orders")
def union_all_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.union_streams(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("event").alias("kind")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind")))


@query("SELECT event_id, 2 AS times FROM events")
def union_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    return routing.union_streams(e, e).groupBy("event_id").agg(F.count("*").alias("times"))


@query("SELECT event_id, 0 AS ordinal FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 1 FROM events WHERE event_type = 'view'")
def double_connection_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return routing.concat_in_order(e.where("event_type = 'click'").select("event_id"), e.where("event_type = 'view'").select("event_id"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM events")
def fair_channel_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.fair_order(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("SELECT CAST(sum(n) AS BIGINT) AS total FROM (SELECT count(*) AS n FROM lineitem)")
def counting_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.count_by_partition(table(spark, sf_dir, "lineitem")).agg(F.sum("n").alias("total"))


@query("SELECT o_orderkey, o_custkey, CAST(CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 8 AS INT) AS channel FROM orders")
def hash_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key is in one channel only."""
    return routing.by_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_custkey"), 8)


_FILES = """
WITH files(file, len, block) AS (VALUES ('a', 0, 64), ('b', 100, 64), ('c', 1000, 64), ('d', 70, 64), ('e', 7, 64), ('f', 141, 64)),
"""
_SPLITS = _FILES + """
size AS (SELECT f.*, greatest(1, least(block, (SELECT CAST(ceil(sum(len) / 10.0) AS BIGINT) FROM files))) AS size FROM files f),
cut AS (SELECT file, len, size, (SELECT count(*) FROM range(0, 2000) k WHERE (len - k.range * size) * 10 > 11 * size) AS cuts FROM size),
splits AS (SELECT file, len, size, cuts, unnest(range(cuts + 1)) AS split_no FROM cut),
done AS (SELECT file, split_no, split_no * size AS start, CASE WHEN split_no < cuts THEN size ELSE len - cuts * size END AS length FROM splits)
"""


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a", 0, 64), ("b", 100, 64), ("c", 1000, 64), ("d", 70, 64), ("e", 7, 64), ("f", 141, 64)], "file string, len long, block long")


@query(_SPLITS + "SELECT * FROM done")
def split_planner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.plan_splits(_files(spark), 10)


@query(_SPLITS + """,
blocks AS (SELECT file, unnest(range(len // 50 + 1)) AS block_no, len FROM files),
own AS (SELECT file, block_no, block_no * 50 AS bs, greatest(1, least(50, len - block_no * 50)) AS bl, lead(block_no) OVER (PARTITION BY file ORDER BY block_no) AS nx FROM blocks)
SELECT d.file, split_no, start, length, CASE WHEN bs + bl - start < length // 2 THEN coalesce(nx, block_no) ELSE block_no END AS host_block
FROM done d JOIN own o ON d.file = o.file AND start >= bs AND start < bs + bl
""")
def split_block_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark)
    no = F.col("block_no")
    blocks = files.select("file", "len", F.explode(F.expr("sequence(0L, len div 50)")).alias("block_no")).select("file", "block_no", (no * 50).alias("block_start"), F.greatest(F.lit(1), F.least(F.lit(50), F.col("len") - no * 50)).alias("block_len"))
    return lines.split_hosts(lines.plan_splits(files, 10), blocks)


@query("""
SELECT o_orderkey, round(o_orderkey * 128 * 8000 / ((1000 + o_orderkey % 977) * 1048576), 4) AS mib_s,
       CAST(floor((1 + o_orderkey % 16) * 8192 / ((1000 + o_orderkey % 977) / 1000.0) + 0.5) AS INT) AS mbit_s FROM orders
""")
def throughput_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ms = 1000 + k % 977
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(lines.mebibits_per_second(k * 128, ms), 4).alias("mib_s"), lines.megabits_per_second(1 + k % 16, ms).alias("mbit_s"))


@query("SELECT doc_id, strlen(text) AS bytes FROM documents")
def str_byte_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.byte_length(F.col("text")).alias("bytes"))


@query("""
SELECT doc_id, CASE WHEN instr(text, 'que') = 0 THEN -1 ELSE strlen(left(text, instr(text, 'que') - 1)) END AS at FROM documents
""")
def str_find_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.byte_find(F.col("text"), "que").alias("at"))


@query("""
WITH b AS (SELECT item_id, list_transform(range(1, strlen(text) * 2, 2), lambda i: CAST('0x' || substr(hex(encode(text)), i, 2) AS INT)) AS bytes FROM benchmark),
s AS (SELECT item_id, list_prepend(CAST(0 AS BIGINT), list_transform(bytes, lambda x: CAST(CASE WHEN x > 127 THEN x - 256 ELSE x END AS BIGINT))) AS bytes FROM b)
SELECT item_id, CAST(list_reduce(bytes, lambda h, x: ((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS INT) AS hash FROM s
""")
def str_hash31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", tx.java_hash31(F.col("text")).alias("hash"))


@query("""
WITH p AS (SELECT doc_id, text, (SELECT min(n.range) FROM range(0, 12) n WHERE strlen(left(text, n.range)) >= 10) AS n FROM documents)
SELECT doc_id, CASE WHEN strlen(text) > 10 AND strlen(left(text, n)) = 10 THEN unicode(substr(text, n + 1, 1)) ELSE -1 END AS code FROM p
""")
def str_codepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.code_point_at(F.col("text"), 10).alias("code"))


@query("SELECT doc_id, coalesce(lang, '') || coalesce(source, '') || '!' AS label FROM documents")
def str_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.append(F.col("lang"), F.col("source"), F.lit("!")).alias("label"))


@query("SELECT min(CAST(doc_id AS VARCHAR)) AS file_name, strlen(text) AS bytes FROM documents GROUP BY text")
def file_record_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_name"), F.encode("text", "UTF-8").alias("content"))
    return lines.distinct_files(files).select("file_name", F.octet_length("content").alias("bytes"))


@query("""
SELECT s_suppkey, 'supplier' AS kind, a.distance FROM (
  SELECT s_suppkey, CASE WHEN s_nationkey = 0 THEN 2 WHEN n.n_regionkey = n0.n_regionkey THEN 4 ELSE 6 END AS distance
  FROM supplier JOIN nation n ON n.n_nationkey = s_nationkey, nation n0 WHERE n0.n_nationkey = 0) a
""")
def topology_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Racks are nations, main switches regions; distance of each supplier from one host in nation 0."""
    n = table(spark, sf_dir, "nation")
    home = n.where("n_nationkey = 0").select(F.concat_ws("/", F.lit("root"), "n_regionkey", "n_nationkey", F.lit("home")).alias("b"))
    hosts = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat_ws("/", F.lit("root"), "n_regionkey", "n_nationkey", "s_suppkey").alias("a"))
    return routing.topology_distance(hosts.join(F.broadcast(home), F.lit(True))).select("s_suppkey", F.lit("supplier").alias("kind"), "distance")


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cut = [(i, n, line) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for n, line in enumerate(t.split("\n")) if line]
        yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cut], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n", "line"])


@query("""
SELECT doc_id, n, lines[n + 1] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents) WHERE lines[n + 1] <> ''
""")
def user_mapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User code from none to many records for each one."""
    return records.map_records(table(spark, sf_dir, "documents").select("doc_id", "text"), _lines_of, "doc_id long, n long, line string")


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one, which is emptied by whoever owns that; a local one in sessions without."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='spark-sink-')}/sink-{uuid.uuid4().hex}"


@query("SELECT o_orderkey || ',' || o_orderpriority AS line FROM orders")
def line_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as lines, read back by the source."""
    folder = _folder(spark)
    lines.write_lines(table(spark, sf_dir, "orders").select(F.concat_ws(",", "o_orderkey", "o_orderpriority").alias("value")), folder)
    return lines.read_lines(spark, folder).select(F.col("value").alias("line"))


@query("SELECT 'doc-' || doc_id AS file_name, CAST(coalesce(strlen(text), 0) AS BIGINT) AS size, sha256(coalesce(text, '')) AS sha FROM documents WHERE coalesce(text, '') <> ''")
def directory_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each document, read back whole. The file source passes over empty files."""
    folder = _folder(spark)
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("file_name"), F.encode("text", "UTF-8").alias("content"))
    lines.write_files(files, folder, FOLDERS)
    return lines.read_spread(spark, folder, FOLDERS).select("file_name", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha"))


@query("SELECT count(*) AS n FROM lineitem")
def discard_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records go to a sink that keeps none; what comes out is how many there were."""
    li = table(spark, sf_dir, "lineitem")
    lines.discard(li)
    return li.agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE strlen(text) > 100)
SELECT doc_id, substr(h, 201, 1) NOT IN ('8', '9', 'A', 'B') AS valid FROM b
""")
def str_strict_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first hundred bytes of a text are valid UTF-8: they are unless they end within a character."""
    raw = F.substring(F.encode("text", "UTF-8"), 1, 100)
    return table(spark, sf_dir, "documents").where(F.octet_length("text") > 100).select("doc_id", tx.valid_utf8(raw.cast("string")).alias("valid"))

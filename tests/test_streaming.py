"""Streams give what batches give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from streamloom.functions.time import millis
from streamloom.operators import records, routing, stats
from streamloom.streaming import operators as st


@pytest.fixture(scope="module")
def batches(spark, sf_dir, tmp_path_factory):
    """Events in three files, in the order of their numbers."""
    folder = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", F.round(F.col("value") * 100).alias("cents"), millis("ts").alias("ms"))
    for k in range(3):
        e.where((F.col("event_id") >= 334 * k) & (F.col("event_id") < 334 * (k + 1))).coalesce(1).write.parquet(f"{folder}/{k}")
    return e, folder


def run(spark, batches, make, name, tmp_path, mode="append"):
    e, folder = batches
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(map(tuple, a.select(*cols).collect()), key=repr) == sorted(map(tuple, b.select(*cols).collect()), key=repr)


def test_count_window(spark, batches, tmp_path):
    got = run(spark, batches, lambda s: st.count_window(s, "user_id", "event_id", "cents", 4), "w", tmp_path)
    want = stats.count_window(batches[0], ["user_id"], "event_id", "cents", 4)
    cols = ["user_id", "event_id", "w_median", "w_min", "w_max", "w_sum", "w_count"]
    same(got.select(*cols), want.select(*cols))


def test_tags(spark, batches, tmp_path):
    got = run(spark, batches, lambda s: st.tag_every(s, "user_id", "event_id", "ms"), "t", tmp_path)
    same(got, records.tag_every(batches[0], ["user_id"], "event_id", F.col("ms")).select("user_id", "event_id", "tag_ts_ms"))


def test_edge_latency(spark, batches, tmp_path):
    make = lambda d: stats.edge_latency(d, ["user_id"], F.col("ms") - F.col("ms") % 1000, F.col("cents").cast("long"))
    same(run(spark, batches, make, "l", tmp_path, "complete"), make(batches[0]))


def test_union(spark, batches, tmp_path):
    got = run(spark, batches, lambda s: routing.union_streams(s, s), "u", tmp_path)
    assert got.count() == 2 * batches[0].count() and got.groupBy("event_id").count().where("count <> 2").isEmpty()


def test_buffers(spark, batches, tmp_path):
    got = run(spark, batches, lambda s: st.ship_buffers(s.withColumn("size", F.col("event_id") % 200), "event_type", "event_id", "size", 1024), "b", tmp_path)
    full = stats.adaptive_buffers(batches[0].withColumn("size", F.col("event_id") % 200), "event_type", "event_id", "size", 1024).where("bytes >= 1024")
    same(got, full.select("event_type", "last_seq", "bytes", "records"))


def test_vertex_latency_resets(spark, tmp_path):
    rows = [("v", 0, 0, "in"), ("v", 1, 5, "in"), ("v", 2, 10, "out"), ("v", 3, 110, "out"), ("v", 4, 120, "in"), ("v", 5, 300, "out"), ("v", 6, 301, "out")]
    df = spark.createDataFrame(rows, "v string, seq long, ms long, kind string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    st.vertex_latency(stream, "v", "seq", "ms", "kind", 100, 2).writeStream.format("memory").queryName("vl").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("vl").collect())) == [("v", 110, 55, 2), ("v", 301, 181, 1)]


def test_control_loop(spark, batches, tmp_path):
    e, folder = batches
    stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(folder)
    decide = lambda b: b.groupBy("user_id").agg(F.max("cents").alias("most"))
    st.control_loop(stream, decide, str(tmp_path / "actions"), str(tmp_path / "check")).awaitTermination()
    same(spark.read.parquet(str(tmp_path / "actions")).drop("batch"), decide(e))

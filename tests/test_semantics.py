"""Behaviours that differ from what one would expect, and values from the fixtures."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from streamloom.functions import text as tx
from streamloom.operators import graph, numbering, qos, records, routing, stats, telemetry
from streamloom.plans import graphs
from streamloom.sources import lines


def test_lines_end_with_line_feed_only(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\n\nz\rw\nlast")
    got = [r[0] for r in lines.read_lines(spark, str(tmp_path / "a.txt")).collect()]
    assert sorted(got) == sorted(["x", "y", "", "z\rw", "last"])
    df = spark.createDataFrame([(1, "x\r\ny\n\nz\rw\nlast"), (2, "a\n"), (3, "")], "id int, text string")
    assert [(r.id, r.line_no, r.value) for r in lines.explode_lines(df, "text").orderBy("id", "line_no").collect()] == [(1, 0, "x"), (1, 1, "y"), (1, 2, ""), (1, 3, "z\rw"), (1, 4, "last"), (2, 0, "a")]


def test_line_sink_writes_crlf(spark, tmp_path):
    path = str(tmp_path / "out")
    lines.write_lines(spark.createDataFrame([("a",), ("b",)], "value string").coalesce(1), path)
    [part] = [p for p in os.listdir(path) if p.startswith("part-")]
    with open(os.path.join(path, part), "rb") as f:
        assert f.read() == b"a\r\nb\r\n"


def test_whole_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, raw in {"a.bin": b"\x00\x01", "b.bin": b"\x00\x01", "c.bin": b"\x02"}.items():
        (tmp_path / "in" / n).write_bytes(raw)
    files = lines.read_files(spark, str(tmp_path / "in"))
    assert files.count() == 3 and lines.distinct_files(files).count() == 2
    lines.write_files(files, str(tmp_path / "out"))
    assert {p: (tmp_path / "out" / p).read_bytes() for p in sorted(os.listdir(tmp_path / "out"))} == {"a.bin": b"\x00\x01", "b.bin": b"\x00\x01", "c.bin": b"\x02"}


@pytest.mark.parametrize(
    ("values", "median", "least", "most", "mean"),
    [
        ([1, 3, 7, 8, 21, 35, 41], 8, 1, 41, 116 / 7),
        ([7, 15, 13, 1, 5, 7.5, 8], 7.5, 1, 15, 56.5 / 7),
        ([18, 15, 13, 10, 9, 8, 7], 10, 7, 18, 80 / 7),
        ([7, 15, 13, 1, 7.5, 5, 18, 13, 10, 8], 8, 1, 18, 62.5 / 7),
        (list(range(1, 11)), 7, 4, 10, 7),
        ([18, 15], 18, 15, 18, 16.5),
        ([18, 15, 17], 17, 15, 18, 50 / 3),
    ],
)
def test_count_window(spark, values, median, least, most, mean):
    df = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(values)], "ch string, seq long, v double")
    for block in (3, 1 << 18):
        frame = {"l": F.collect_list("v"), "a": F.min("v"), "b": F.max("v"), "m": F.avg("v")}
        r = numbering.over_last(df, ["ch"], "seq", 7, frame, block).withColumn("med", numbering.upper_median(F.col("l"))).orderBy(F.col("seq").desc()).first()
        assert (r.med, r.a, r.b) == (median, least, most) and abs(r.m - mean) < 1e-9


def test_numbering_over_blocks(spark):
    df = spark.range(0, 1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 - 2000).alias("seq"))
    got = numbering.numbered(df, ["k"], "seq", "pos", block=64).orderBy("k", "seq").collect()
    for k in range(3):
        assert [r.pos for r in got if r.k == k] == list(range(1, 1 + sum(r.k == k for r in got)))
    assert sorted(r.pos for r in numbering.numbered(df, [], "seq", "pos", block=10).collect()) == list(range(1, 1001))


def test_round_robin_starts_at_one(spark):
    df = spark.range(6).withColumn("p", F.lit(0))
    assert [r.channel for r in routing.round_robin(df, ["p"], "id", 4).orderBy("id").collect()] == [1, 2, 3, 0, 1, 2]


def test_selector_drops_null_and_unknown(spark):
    df = spark.createDataFrame([(1, [0, 1]), (2, None), (3, [7, 2, -1])], "id int, to array<int>")
    assert sorted((r.id, r.channel) for r in routing.select_channels(df, F.col("to"), 4).collect()) == [(1, 0), (1, 1), (3, 2)]


def test_union_needs_two_streams_of_one_type(spark):
    a = spark.range(3)
    with pytest.raises(ValueError):
        routing.union_streams(a)
    with pytest.raises(ValueError):
        routing.union_streams(a, spark.createDataFrame([("x",)], "id string"))
    assert routing.union_streams(a, a).count() == 6


def test_grep_forwards_unless_told_otherwise(spark):
    df = spark.createDataFrame([("a",), ("b",)], "v string")
    assert records.grep(df, "v", "a").count() == 2 and records.grep(df, "v", "a", strict=False).count() == 1


def test_event_before_the_999th_record(spark):
    assert [r.pos for r in records.event_positions(spark.range(2500), "id").orderBy("pos").collect()] == [999, 1999]


def test_large_shares_do_not_overflow():
    assert lines.records_for(1024, 2) == 512 * 1024 * 1024 * 1024 // 128


def test_text_functions(spark):
    df = spark.createDataFrame([("aé",), ("",), ("Test Record",)], "t string")
    rows = df.select("t", tx.byte_length(F.col("t")).alias("n"), tx.byte_find(F.col("t"), "é").alias("f"), tx.java_hash31(F.col("t")).alias("h"), tx.code_point_at(F.col("t"), 1).alias("c"), tx.code_point_at(F.col("t"), 2).alias("d")).collect()

    def h31(s):
        h = 0
        for b in s.encode():
            h = (31 * h + (b - 256 if b > 127 else b)) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    for r in rows:
        assert r.n == len(r.t.encode()) and r.f == r.t.encode().find("é".encode()) and r.h == h31(r.t)
    assert [(r.c, r.d) for r in rows] == [(233, -1), (-1, -1), (101, 115)]


def test_total_drops_fractions_each_time(spark):
    r = spark.createDataFrame([([0.6, 0.6, 0.6],), ([1.5, 1.7],)], "l array<double>").select(qos.truncated_total(F.col("l"))).collect()
    assert [x[0] for x in r] == [0, 2]


def test_violations_either_way(spark):
    df = spark.createDataFrame([(0, 2000), (2000, 2000), (2099, 2000), (2101, 2000)], "total long, most long")
    assert sorted((r.total, r.excess) for r in qos.violations(df, "total", "most").collect()) == [(0, -2000), (2101, 101)]


def test_resize_rules(spark):
    rows = [(1, 1000, 20.0, 10.0, 5), (2, 1000, 1.0, 10.0, 5), (3, 1000, 6.0, 10.0, 5), (4, 1000, 20.0, 10.0, -5), (5, 60, 200.0, 10.0, 5), (6, 200, 2.0, 10.0, 1), (7, 32000, 0.0, 10.0, 1)]
    got = {r.id: (r.action, r.new_size) for r in qos.resize_buffers(spark.createDataFrame(rows, "id int, size int, lifetime double, records_s double, excess int"), 32768).collect()}
    assert got == {1: ("shrink", int(1000 * 0.95**10)), 2: ("grow", 1200), 5: ("shrink", 50), 7: ("grow", 32768)}


def test_self_loop_is_no_cycle(spark):
    assert sorted(r.node for r in graph.cycle_vertices(graphs.cyclic(spark)).collect()) == ["a", "b", "c"]


def test_no_path_raises(spark):
    with pytest.raises(ValueError):
        graph.sequences(graphs.edges(spark), "out", "in")


def test_paths_of_any_length(spark):
    """A path of 66 edges beside a short one; a cycle on the way raises."""
    line = [(f"n{i}", 0, f"n{i + 1}", 0) for i in range(66)]
    e = spark.createDataFrame([*line, ("n0", 1, "n66", 1)], "src string, out_gate int, dst string, in_gate int")
    assert sorted(r.n_elements for r in graph.sequences(e, "n0", "n66").collect()) == [3, 133]
    with pytest.raises(ValueError, match="cycle"):
        graph.sequences(graphs.cyclic(spark), "a", "e")


def test_components_of_a_long_line(spark):
    n = 200
    e = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.components(spark.range(n + 2).withColumnRenamed("id", "node"), e).collect()
    assert {r.node: r.component for r in got} == {i: 0 if i <= n else i for i in range(n + 2)}


def test_graphs_of_whole_tables(spark, sf_dir):
    """Reach and components over all edges, against plain Python."""
    o = [(f"c{r[0]}", f"o{r[1]}") for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey").collect()]
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey").collect()
    out, ties = {}, {}
    for a, b in [*o, *((f"o{r[0]}", f"s{r[2]}") for r in li)]:
        out.setdefault(a, set()).add(b)
    for r in li:
        ties.setdefault(f"p{r[1]}", set()).add(f"s{r[2]}")
        ties.setdefault(f"s{r[2]}", set()).add(f"p{r[1]}")

    def reached(start, steps):
        seen, front = {start}, [start]
        while front:
            new = steps.get(front.pop(), set()) - seen
            seen |= new
            front += new
        return seen

    want = {}
    for n in sorted(ties):
        if n not in want:
            want.update(dict.fromkeys(reached(n, ties), n))
    assert {r.node for r in graphs.order_reach(spark, sf_dir).collect()} == reached("c1", out)
    assert {r.node: r.component for r in graphs.supply_components(spark, sf_dir).collect()} == want


def test_rack_distances(spark):
    nodes = {"node01": "root/m1/r1/node01", "node02": "root/m1/r1/node02", "node05": "root/m1/r2/node05", "node11": "root/m2/r3/node11", "rack1": "root/m1/r1"}
    df = spark.createDataFrame([(nodes[a], nodes[b], d) for a, b, d in [("node01", "node01", 0), ("node01", "node02", 2), ("node01", "node05", 4), ("node01", "node11", 6), ("rack1", "node01", 1)]], "a string, b string, want int")
    assert all(r.distance == r.want for r in routing.topology_distance(df).collect())


def test_failed_jobs_are_not_archived(spark):
    df = spark.createDataFrame([("FINISHED",), ("FAILED",), ("CANCELED",)], "s string")
    assert telemetry.archived_jobs(df, "s").count() == 2 and telemetry.archived_jobs(df, "s", strict=False).count() == 3


def test_last_statistics_win(spark):
    df = spark.createDataFrame([("e", 1, 10), ("e", 2, 20), ("f", 1, 5)], "k string, seq int, v int")
    assert sorted(tuple(r) for r in stats.last_report(df, ["k"], "seq", "v").collect()) == [("e", 20), ("f", 5)]


def test_accommodation(spark):
    got = {(r.host_type, r.type): r.times for r in telemetry.accommodation(__import__("streamloom.plans.telemetry", fromlist=["types"]).types(spark)).collect()}
    assert got[("large", "large")] == 1 and got[("large", "medium")] == 2 and got[("large", "small")] == 4 and got[("small", "large")] == 0


def test_exception_reaches_the_client(spark):
    def fail(batches):
        raise RuntimeError("This is an expected test exception")
        yield from batches

    with pytest.raises(Exception, match="This is an expected test exception"):
        records.map_records(spark.range(3), fail, "id long").collect()


def test_slices_fit(spark):
    df = spark.createDataFrame([(0, 1, 5, 1), (0, 2, 4, 1), (0, 3, 3, 1), (0, 4, 0, 7), (0, 5, 0, 6), (1, 1, 9, 0), (1, 2, 8, 8)], "i int, o long, c int, m int")
    got = sorted((r.i, r.o, r.granted) for r in telemetry.pack_slices(df, "i", "o", {"c": 8, "m": 8}).collect())
    assert got == [(0, 1, True), (0, 2, False), (0, 3, True), (0, 4, False), (0, 5, True), (1, 1, False), (1, 2, True)]


def test_cycles_against_all_paths(spark):
    """Strongly connected components of random graphs, nested and touching ones, by comparing what vertices reach."""
    rng = random.Random(6)
    for n, m in ((12, 14), (12, 20), (30, 36)):
        e = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        far = {a: {b for x, b in e if x == a} for a in range(n)}
        while True:
            new = {a: far[a] | {c for b in far[a] for c in far[b]} for a in far}
            if new == far:
                break
            far = new
        want = sorted(a for a in far if any(b != a and a in far[b] for b in far[a]))
        df = spark.createDataFrame(sorted(e), "src long, dst long")
        assert sorted(r.node for r in graph.cycle_vertices(df).collect()) == want


def test_sharing_cycles(spark):
    v = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "d"), ("e", "a"), ("f", None)], "id string, share_with string")
    assert sorted(r.node for r in graph.sharing_cycles(v).collect()) == ["b", "c", "d"]


def test_levels_of_a_cycle_raise(spark):
    v = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "id string")
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(v, graphs.cyclic(spark))


def test_best_merge_by_all_runs(spark):
    """Also where the line of sums is cut into short stretches."""
    rng, rows = random.Random(7), []
    for w in range(6):
        rows += [(w, i, rng.randrange(1, 60)) for i in range(rng.choice((1, 5, 60)))]
    want = {}
    for w in range(6):
        cpu = [c for x, _, c in rows if x == w]
        runs = [(sum(cpu[a : b + 1]), -a, -b) for a in range(len(cpu)) for b in range(a + 1, len(cpu)) if sum(cpu[a : b + 1]) <= 91]
        if runs:
            c, a, b = max(runs)
            want[w] = (-a, -b, c)
    df = spark.createDataFrame(rows, "worker long, idx long, cpu long")
    for stretch in (1 << 18, 100):
        assert {r.worker: (r.first, r.last, r.cpu) for r in qos.best_merge(df, stretch=stretch).collect()} == want


def test_blocks_change_nothing(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", ((F.col("event_id") * 7919) % 1009).alias("at"))
    one, many = (sorted(map(tuple, stats.stale_values(e, ["user_id"], "at", "event_id", block).collect())) for block in (1 << 32, 50))
    assert one == many and one
    a, b = (sorted(map(tuple, numbering.prefix_sums(e, "user_id", "event_id", "at", "s", block).collect())) for block in (1 << 18, 30))
    assert a == b


def test_claims_by_hand(spark):
    """Each round every instance asks for its nearest split; a split goes to the nearest asker."""
    rng = random.Random(8)
    near = {(i, s): rng.randrange(9) for i in range(5) for s in range(17)}
    left, want, k = set(range(17)), {}, 0
    while left:
        asked = {}
        for i in range(5):
            d, s = min((near[i, s], s) for s in left)
            asked.setdefault(s, []).append((d, i))
        for s, who in asked.items():
            want[s] = (min(who)[1], k)
            left.discard(s)
        k += 1
    df = spark.createDataFrame([(i, s, d) for (i, s), d in near.items()], "instance long, split long, distance long")
    assert {r.split: (r.instance, r["round"]) for r in telemetry.claimed_splits(df).collect()} == want


def test_latency_by_emissions(spark):
    """The same rows as on the stream."""
    rows = [("v", 0, 0, 1, 0), ("v", 1, 5, 1, 0), ("v", 2, 10, 0, 1), ("v", 3, 110, 0, 1), ("v", 4, 120, 1, 0), ("v", 5, 300, 0, 1), ("v", 6, 301, 0, 1)]
    df = spark.createDataFrame(rows, "v string, seq long, ms long, got int, sent int")
    assert sorted(map(tuple, stats.latency_by_emissions(df, "v", "seq", "ms", "got", "sent", 2).collect())) == [("v", 110, 2, 55), ("v", 301, 1, 181)]


def test_model_states(spark):
    models, expected = spark.createDataFrame([("m",), ("n",), ("o",)], "m string"), spark.createDataFrame([("m", 1), ("m", 2), ("n", 3), ("n", 4), ("o", 5)], "m string, k int")
    said = spark.createDataFrame([("m", 1, 10), ("m", 2, 20), ("m", 1, 30), ("n", 3, 5)], "m string, k int, t long")
    states = qos.model_states(models, expected, said, "m", "k", "t")
    assert sorted(map(tuple, states.collect())) == [("m", "READY", 20), ("n", "SHALLOW", None), ("o", "EMPTY", None)]
    measured = spark.createDataFrame([(1, 19), (1, 20), (3, 99)], "k int, t long")
    assert [(r.k, r.t) for r in qos.ready_measurements(measured, expected, states, "k", "m", "t").collect()] == [(1, 20)]


def test_hot_nodes_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 20)
    monkeypatch.setattr(graph, "HOT", 15)
    e = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(30)], "src long, dst long")
    got = {r.node: r.component for r in graph.components(e.select(F.col("src").alias("node")).union(e.select("dst")), e).collect()}
    assert got == {i: 0 for i in range(60)} | {100 + i: 100 for i in range(31)}


def test_control_events_keep_their_place(spark):
    data, control = spark.createDataFrame([(i, f"r{i}") for i in range(4)], "seq long, value string"), spark.createDataFrame([(2, "stop")], "seq long, event string")
    merged = records.merge_control(data, control, "seq").orderBy("seq", "kind").collect()
    assert [r.event or r.value for r in merged] == ["r0", "r1", "stop", "r2", "r3"]

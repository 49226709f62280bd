"""Jobs whose cost must not grow faster than their tables, and the same results by each of their ways."""

from __future__ import annotations

import os
import random

import pytest

from streamloom.operators import graph, stats, telemetry
from streamloom.sources import lines


def claims(near: dict[tuple, int], times: int = 1 << 30) -> dict:
    """Rounds by hand: (instance, split) to distance."""
    who, left, want, k = {i for i, _ in near}, {s for _, s in near}, {}, 0
    while left and k < times:
        asked = {}
        for i in who:
            wishes = [(near[i, s], s) for s in left if (i, s) in near]
            if wishes:
                d, s = min(wishes)
                asked.setdefault(s, []).append((d, i))
        for s, askers in asked.items():
            want[s] = (min(askers)[1], k)
            left.discard(s)
        k += 1
    return want


def claimed(spark, near, **how) -> dict:
    df = spark.createDataFrame([(i, s, d) for (i, s), d in near.items()], "instance long, split long, distance long")
    rows = telemetry.claimed_splits(df, **how).collect()
    assert len(rows) == len({r.split for r in rows})
    return {r.split: (r.instance, r["round"]) for r in rows}


def test_claims_take_few_jobs(spark, monkeypatch):
    """150 rounds of claims of splits near one instance each, in a few cuts of lineage, not three for each round."""
    near = {(i, s): abs(i - s % 3) for i in range(3) for s in range(450)}
    cuts = []
    monkeypatch.setattr(telemetry, "_cut", lambda df, cut=telemetry._cut: cuts.append(1) or cut(df))
    got = claimed(spark, near)
    assert got == claims(near) and max(k for _, k in got.values()) == 149
    assert len(cuts) <= 10


@pytest.mark.parametrize("how", [{}, {"rows": 60}, {"rows": 12}, {"rows": 1}, {"times": 4}, {"times": 4, "rows": 40}, {"times": 0}])
def test_claims_in_each_others_way(spark, how):
    """Lists at random, some of them short: by turns of several sizes, and by what fits alone."""
    rng = random.Random(12)
    near = {(i, s): rng.randrange(6) for i in range(4) for s in range(40) if i != 2 or s % 5 == 0}
    assert claimed(spark, near, **how) == claims(near, how.get("times", 1 << 30))


def ranks(splits: list[tuple], distances: list[tuple]) -> set:
    """Rows by hand: every host of a split with every instance that knows it; none is the one that knows all others."""
    best = {}
    for s, h in splits:
        for i, d in [(i, d) for i, g, d in distances if g == h] or [(None, telemetry.NO_DISTANCE)]:
            best[i, s] = min(d, best.get((i, s), d))
    lists = {}
    for (i, s), d in best.items():
        lists.setdefault(i, []).append((d, s))
    return {(i, s, d, k) for i, own in lists.items() for k, (d, s) in enumerate(sorted(own), 1)}


@pytest.mark.parametrize("known", [1.0, 0.7])
def test_ranks_of_splits(spark, known):
    """Instances that know all hosts and such that don't, hosts alike and not, hosts that no one knows; far numbers."""
    rng = random.Random(3)
    distances = [(i, h, 2 if h % 3 == i else 4 if h < 12 else rng.randrange(9)) for i in range(4) for h in range(15) if rng.random() < known]
    splits = [(s * (1 if s % 2 else 100_000), rng.choice([*range(15), 99])) for s in range(60) for _ in range(3)]
    got = telemetry.nearest_splits(spark.createDataFrame(splits, "split long, host long"), spark.createDataFrame(distances, "instance long, host long, distance int")).collect()
    assert {(r.instance, r.split, r.distance, r["rank"]) for r in got} == ranks(splits, distances) and len(got) == len(set(got))


def test_ranks_shuffle_no_product(spark, monkeypatch):
    """20 equal hosts of a split and 50 instances: what is dealt out has a row for a split and its kind of host, no more."""
    seen = []
    monkeypatch.setattr(telemetry, "_placed", lambda rows, placed=telemetry._placed: seen.append(rows) or placed(rows))
    splits = spark.range(400).selectExpr("id div 20 AS split", "id % 20 AS host")
    distances = spark.range(1000).selectExpr("id % 50 AS instance", "id div 50 AS host", "3 AS distance")
    assert telemetry.nearest_splits(splits, distances).count() == 1000
    far = seen[0]._jdf.queryExecution()
    far.executedPlan().execute().count()
    plan = far.executedPlan().toString()
    assert "Exchange hashpartitioning(split" in plan and not [x for x in plan.split("\n") if "Exchange" in x and "instance" in x]


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_files_in_many_folders(spark, tmp_path, scheme):
    """Files dealt to folders, read back by tasks that list those; the last part of a name counts, empty files don't."""
    want = {f"f{i}": bytes([i % 256]) * (i + 1) for i in range(300)} | {"u": b"up", "n ü%20.txt": b"\xff\x00"}
    files = [(k, v) for k, v in want.items() if k != "u"] + [("../../u", b"up"), ("empty", b""), ("none", None), (".hidden", b"x")]
    folder = f"{scheme}{tmp_path}/out"
    lines.write_files(spark.createDataFrame(files, "file_name string, content binary"), folder, 16)
    kept = [os.listdir(tmp_path / "out" / d) for d in os.listdir(tmp_path / "out")]
    assert sorted(os.listdir(tmp_path)) == ["out"] and len(kept) == 16 and max(map(len, kept)) < 60
    assert not [n for names in kept for n in names if n.endswith(".part")]
    got = lines.read_spread(spark, folder, 16)
    assert got.rdd.getNumPartitions() <= 16
    rows = got.collect()
    assert {r.file_name: bytes(r.content) for r in rows} == want and len(rows) == len(want)


def test_other_stores_are_refused(spark):
    with pytest.raises(ValueError, match="mount"):
        lines.write_files(spark.createDataFrame([("a", b"a")], "file_name string, content binary"), "hdfs://store/x", 4)


def test_dense_graphs_shrink_first(spark, monkeypatch):
    """Two dense graphs of 200 and 20 nodes a side, each edge twice: what is kept has a row for each node, not each edge."""
    cuts = []
    monkeypatch.setattr(graph, "_cut", lambda df, cut=graph._cut: cuts.append(cut(df)) or cuts[-1])
    e = spark.range(16_000).selectExpr("concat('p', id % 400) AS src", "concat('s', 20 * (id % 400 div 200) + id div 400 % 20) AS dst")
    nodes = e.selectExpr("src AS node").union(e.select("dst")).union(spark.sql("SELECT 'alone'"))
    got = {r.node: r.component for r in graph.components(nodes, e).collect()}
    want = {f"{a}{i}": "p0" if i < n else "p200" for a, n in (("p", 200), ("s", 20)) for i in range(2 * n)} | {"alone": "alone"}
    assert got == want
    assert max(c.count() for c in cuts) < 1_000


def test_summary_in_many_tasks(spark):
    """Repeated reports and nameless instances, on few shuffle partitions: reports are summed in 200 tasks, not in 4."""
    df = spark.createDataFrame([(1, 1, 10), (1, 1, 20), (1, 2, 5), (1, None, 7), (2, 1, 4), (3, 1, None), (3, 2, 9)], "r int, i int, m long")
    out = stats.cluster_summary(df, "r", "i", ["m"], 2)
    assert sorted(tuple(x) for x in out.collect()) == [(1, 2, 10), (3, 2, 4)]
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()

"""Events, states, archives, splits and resources of the engine as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .graph import FEW, _cut

#: Allowed changes of a task's state.
TRANSITIONS = [
    ("CREATED", "SCHEDULED"), ("SCHEDULED", "ASSIGNED"), ("ASSIGNED", "READY"), ("READY", "STARTING"), ("STARTING", "RUNNING"),
    ("RUNNING", "FINISHING"), ("FINISHING", "FINISHED"), ("SCHEDULED", "CANCELED"), ("ASSIGNED", "CANCELED"), ("READY", "CANCELED"),
    ("STARTING", "FAILED"), ("RUNNING", "FAILED"), ("FINISHING", "FAILED"), ("RUNNING", "CANCELING"), ("FINISHING", "CANCELING"), ("CANCELING", "CANCELED"),
]
ARCHIVE_SIZE = 20
NO_DISTANCE = 2**31 - 1
MOST_TYPES = 1_000
#: Rows of a table of wishes that one task claims in turn.
TURN_ROWS = 2_000_000


def first_status_time(events: DataFrame, keys: list[str], status: str, wanted: str, time: Column) -> DataFrame:
    """Time of the first event with a status, 0 if there is none."""
    return events.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col(status) == wanted, time)), F.lit(0)).alias("first_ms"))


def new_events(events: DataFrame, seen: DataFrame, job: str, seq: str) -> DataFrame:
    """Events of each job that a client hasn't seen yet: numbers above its last one."""
    return events.join(seen, job, "left").where(F.col(seq) > F.coalesce(F.col("last_seq"), F.lit(-1))).drop("last_seq")


def expired(events: DataFrame, time: Column, interval: int, now: Column) -> DataFrame:
    """Events that move to the archive: their time and the interval are before now."""
    return events.where(time + interval < now)


def archived_jobs(jobs: DataFrame, status: str, strict: bool = True) -> DataFrame:
    """Jobs whose summary is archived. Failed ones are left out, as finished is tested twice in the model of this rule;
    ``strict=False`` archives them too."""
    ends = ["FINISHED", "CANCELED"] + ([] if strict else ["FAILED"])
    return jobs.where(F.col(status).isin(ends))


def archive_last(events: DataFrame, job: str, time: str, n: int = ARCHIVE_SIZE) -> DataFrame:
    """The ``n`` jobs that were archived first most recently; archiving one again doesn't move it. Ties by job."""
    return events.groupBy(job).agg(F.min(time).alias("first_archived")).orderBy(F.col("first_archived").desc(), F.col(job).desc()).limit(n)


def illegal_transitions(events: DataFrame, task: str, seq: str, state: str, allowed: DataFrame) -> DataFrame:
    """Changes of state that aren't allowed, by task; the first state has none before it and is not judged."""
    w = Window.partitionBy(task).orderBy(seq)
    moves = events.select(task, seq, F.lag(state).over(w).alias("from_state"), F.col(state).alias("to_state")).where("from_state IS NOT NULL")
    return moves.join(F.broadcast(allowed), ["from_state", "to_state"], "left_anti")


def job_status(vertices: DataFrame, job: str, state: str) -> DataFrame:
    """Status of each job from its vertices' states: failed, canceled, finished, running, scheduled or created."""
    has = lambda s: F.max((F.col(state) == s).cast("int")) == 1
    only = lambda *s: F.min(F.col(state).isin(*s).cast("int")) == 1
    ends = F.when(has("FAILED"), F.when(only("FAILED", "CANCELED", "FINISHED"), "FAILED").otherwise("FAILING"))
    ends = ends.when(has("CANCELED") | has("CANCELING"), F.when(only("CANCELED", "FINISHED"), "CANCELED").otherwise("CANCELING"))
    return vertices.groupBy(job).agg(ends.when(only("FINISHED"), "FINISHED").when(has("RUNNING") | has("FINISHING") | has("FINISHED"), "RUNNING").when(only("CREATED"), "CREATED").otherwise("SCHEDULED").alias("status"))


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.to_json(F.struct(*columns)).alias("json"))


def job_detail(events: DataFrame, job: str, vertex: str, seq: str, state: str, time: str) -> DataFrame:
    """One JSON text for each job: its vertices in order, each with its last state and when it first had each state."""
    first = events.groupBy(job, vertex, state).agg(F.min(time).alias("__ms"))
    times = first.groupBy(job, vertex).agg(F.sort_array(F.collect_list(F.struct(F.col("__ms").alias("ms"), F.col(state).alias("state")))).alias("times"))
    last = events.groupBy(job, vertex).agg(F.max_by(state, seq).alias("state"))
    per = last.join(times, [job, vertex]).groupBy(F.col(job).alias("job")).agg(F.sort_array(F.collect_list(F.struct(F.col(vertex).alias("vertex"), "state", "times"))).alias("vertices"))
    return per.select("job", F.to_json(F.struct("job", "vertices")).alias("json"))


def alive(beats: DataFrame, instance: str, time: Column, now: Column, timeout: int = 120_000) -> DataFrame:
    """Last sign of life of each instance, and whether it is recent enough."""
    return beats.groupBy(instance).agg(F.max(time).alias("last_ms")).withColumn("alive", F.col("last_ms") + timeout >= now)


def match_type(hosts: DataFrame, types: DataFrame, pinned: DataFrame) -> DataFrame:
    """Instance type of each host (host, cores, memory): the one pinned to it, else the first, by cores downwards, that
    needs no more cores and memory than it has. Types are a configured list: all of them come as one array to each host's
    row; more than ``MOST_TYPES`` are an error."""
    listed = types.groupBy().agg(F.sort_array(F.collect_list(F.struct("t_cores", "t_memory", "type")), asc=False).alias("types"))
    if listed.first()["types"] and len(listed.first()["types"]) > MOST_TYPES:
        raise ValueError(f"over {MOST_TYPES} instance types")
    fits = F.filter("types", lambda t: (t["t_cores"] <= F.col("cores")) & (t["t_memory"] <= F.col("memory")))
    best = hosts.join(F.broadcast(listed)).select("host", F.get(fits, F.lit(0))["type"].alias("fits"))
    return best.join(pinned, "host", "left").select("host", F.coalesce("pinned", "fits").alias("type"))


def accommodation(types: DataFrame) -> DataFrame:
    """How often each type fits into each other: the least quotient over all dimensions. 1 for a type and itself."""
    a = types.select(*[F.col(c).alias(f"host_{c}") for c in types.columns])
    per = [F.expr(f"host_{c} div {c}") for c in ("t_cores", "t_units", "t_memory", "t_disk")]
    # A handful of configured types, each with each: the matrix itself is the result.
    return a.join(F.broadcast(types), F.lit(True)).select("host_type", "type", F.when(F.col("host_type") == F.col("type"), 1).otherwise(F.least(*per)).alias("times"))


def demand(vertices: DataFrame, keys: list[str], instance: str, is_input: Column) -> DataFrame:
    """Distinct instances that a stage asks for at most, and at least: those that host inputs, or else all."""
    most = F.countDistinct(instance)
    least = F.countDistinct(F.when(is_input, F.col(instance)))
    return vertices.groupBy(*keys).agg(most.alias("most"), F.when(least == 0, most).otherwise(least).alias("least"))


def admitted(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """Jobs that can be queued: at least as many instances of each type as they need; -1 stands for any number."""
    short = (F.coalesce("n_available", F.lit(0)) != -1) & (F.col("least") > F.coalesce("n_available", F.lit(0)))
    return wanted.join(available, "type", "left").groupBy("job").agg((F.max(short.cast("int")) == 0).alias("admitted"))


def _few(df: DataFrame) -> DataFrame:
    """``df`` for a broadcast if it has few rows; it should be cheap to count, such as ``_cut(...)``."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def nearest_splits(splits: DataFrame, distances: DataFrame) -> DataFrame:
    """Order in which an instance asks for splits (split, host): by least distance of their hosts, then by number; hosts
    that aren't known are farthest.

    Hosts that are equally far from every instance are of one kind. A split's kinds meet the instances where all rows of
    the split are, so that the product isn't shuffled. If all instances know all kinds, a split's first kind brings the
    largest distance of each instance, and others only bring what is less.
    """
    alike = ["__n", "__h1", "__h2"]
    sums = [F.sum(F.xxhash64("instance", "distance", F.lit(seed)).cast("decimal(20,0)")).alias(f"__h{seed}") for seed in (1, 2)]
    hosts = _cut(distances.groupBy("host").agg(F.count("*").alias("__n"), *sums))
    kinds = _cut(hosts.groupBy(*alike).agg(F.min("host").alias("host")).withColumn("kind", F.monotonically_increasing_id()))
    of_host = _cut(hosts.join(_few(kinds.drop("host")), alike).select("host", "kind"))
    near = _cut(distances.join(_few(kinds.select("host", "kind")), "host").select("kind", "instance", F.coalesce("distance", F.lit(NO_DISTANCE)).alias("distance")))
    most = _cut(near.groupBy("instance").agg(F.max("distance").alias("__most"), F.count("*").alias("__n"), F.countDistinct("kind").alias("__kinds")))
    n = int(splits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Kind -2: hosts that aren't known. Kind -1: any that is.
    pairs = splits.join(_few(of_host), "host", "left").select("split", F.coalesce("kind", F.lit(-2)).alias("kind")).distinct().repartition(n, "split")
    if most.where((F.col("__n") != kinds.count()) | (F.col("__n") != F.col("__kinds")) | F.col("instance").isNull()).isEmpty():
        first = F.row_number().over(Window.partitionBy("split").orderBy(F.col("kind").desc())) == 1
        pairs = pairs.withColumn("__first", first).select("split", F.explode(F.when(F.col("__first") & (F.col("kind") >= 0), F.array("kind", F.lit(-1).cast("long"))).otherwise(F.array("kind"))).alias("kind"))
        near = near.join(_few(most), "instance").where("distance < __most").select("kind", "instance", "distance").union(most.select(F.lit(-1).cast("long"), "instance", "__most"))
    unknown = most.groupBy().agg(F.lit(-2).cast("long").alias("kind"), F.min("instance").alias("i")).select("kind", F.when(F.lit(False), F.col("i")).alias("instance"), F.lit(NO_DISTANCE).alias("distance"))
    far = pairs.join(_few(_cut(near.union(unknown))), "kind").groupBy("split", "instance").agg(F.min("distance").alias("distance"))
    return _placed(far).select("instance", "split", "distance", (F.col("pos") + 1).cast("int").alias("rank"))


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` (instance, split, distance) with ``pos``, from 0: the place of a split in its instance's list, by distance,
    then by number. Whole numbers are numbered by blocks of them, after those of the blocks before."""
    whole = isinstance(rows.schema["split"].dataType, T.NumericType)
    own = rows.withColumn("__k", F.struct("instance", "distance", (F.floor(F.col("split") / (1 << 16)) if whole else F.lit(0)).alias("b")))
    earlier = Window.partitionBy("__k.instance").orderBy("__k.distance", "__k.b").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy("__k").agg(F.count("*").alias("__n"))
    offsets = counts.select("__k", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__k").orderBy("split"))
    return own.withColumn("__at", at).join(offsets, "__k").select(*rows.columns, (F.col("__before") + F.col("__at") - 1).alias("pos"))


def _asked(lists: DataFrame, block: int = 1 << 16) -> DataFrame:
    """``lists`` with ``ask``: the round in which an instance first asks for a split, if those before it in its list are
    gone by their ``gone``. Blocks of places take the latest round of the blocks before them."""
    rows = lists.withColumn("__b", F.floor(F.col("pos") / block))
    tops = rows.groupBy("instance", "__b").agg(F.max("gone").alias("__top"))
    before = Window.partitionBy("instance").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tops.select("instance", "__b", F.max("__top").over(before).alias("__old"))
    inside = Window.partitionBy("instance", "__b").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    full = rows.withColumn("__new", F.max("gone").over(inside)).join(offsets, ["instance", "__b"])
    return full.select(*lists.columns, F.coalesce(F.greatest("__new", "__old") + 1, F.lit(0)).alias("ask"))


def _in_turn(batches: Iterator[pa.RecordBatch], most: int, times: int) -> Iterator[pa.RecordBatch]:
    """Rounds one by one over the first ``most`` splits of each list, until a list needs one more or for ``times`` rounds."""
    parts = list(batches)
    if not parts:
        return
    t = pa.Table.from_batches(parts).sort_by([("instance", "ascending"), ("pos", "ascending")]).combine_chunks()
    code = [t[c].combine_chunks().dictionary_encode() for c in ("instance", "split")]
    who, split = code[0].indices.to_numpy(), code[1].indices.to_numpy().tolist()
    far = t["distance"].to_pylist()
    ends = [*np.flatnonzero(np.diff(who, prepend=-1)).tolist(), len(who)]
    at, gone, out, k = ends[:-1], [False] * len(code[1].dictionary), [], 0
    while k < times:
        best: dict[int, tuple] = {}
        for i, end in enumerate(ends[1:]):
            p = at[i]
            while p < end and gone[split[p]]:
                p += 1
            at[i] = p
            if p - ends[i] >= most:
                best = {}
                break
            if p < end:
                best[split[p]] = min(best.get(split[p], (far[p], i)), (far[p], i))
        if not best:
            break
        for s, (_, i) in best.items():
            gone[s] = True
            out.append((s, i, k))
        k += 1
    s, i, r = (pa.array([o[c] for o in out], pa.int32()) for c in range(3))
    for b in pa.Table.from_arrays([code[1].dictionary.take(s), code[0].dictionary.take(i), r], names=["split", "instance", "round"]).to_batches(1 << 16):
        yield b


def claimed_splits(wanted: DataFrame, times: int | None = None, rows: int = TURN_ROWS) -> DataFrame:
    """(split, instance, round): which instance gets each split, of ``wanted`` (instance, split, distance).

    In each round every instance that still wants something asks for the nearest split that is left (ties by number), and
    a split goes to the nearest asker (ties by least instance) and is gone. Rounds go on until nothing is left to claim,
    or for ``times`` rounds.

    Many rounds are settled at once. An instance asks for a split one round after the last of those before it in its list
    is gone, and a split is gone in the first round in which one asks for it; only one table of rounds fits both. A
    split's first place in any list is tried; rounds below the first that doesn't fit are right. Where instances get in
    each other's way, so that few rounds fit, the nearest splits of each, ``rows`` in all, are claimed in turn by one
    task, as each round needs the one before it.
    """
    left, got, done = _cut(wanted.select("instance", "split", "distance").where("instance IS NOT NULL AND split IS NOT NULL")), None, 0
    most = max(1, rows // max(1, left.select("instance").distinct().count()))
    kinds = {f.name: f for f in left.schema.fields}
    schema = T.StructType([kinds["split"], kinds["instance"], T.StructField("round", T.IntegerType())])
    while (times is None or done < times) and not left.isEmpty():
        lists = _cut(_placed(left))
        first = lists.groupBy("split").agg(F.min("pos").alias("gone"))
        asks = _cut(_asked(lists.join(first, "split")))
        per = _cut(asks.groupBy("split").agg(F.min("ask").alias("ask"), F.first("gone").alias("gone"), F.min(F.struct("ask", "distance", "instance")).alias("g")))
        fits = per.where("ask <> gone").agg(F.min(F.least("ask", "gone"))).first()[0]
        # In turn at least most / instances rounds are settled: every one takes a split from each list at most.
        if fits is not None and fits < most * most // max(1, rows):
            near = lists.where(F.col("pos") <= most).select("instance", "split", "distance", "pos")
            limit = 2**31 - 1 if times is None else times - done
            given = near.repartition(1).mapInArrow(lambda b, m=most, n=limit: _in_turn(b, m, n), schema)
        else:
            bounds = [x for x in (fits, None if times is None else times - done) if x is not None]
            given = per.where(F.col("ask") < min(bounds)) if bounds else per
            given = given.select("split", F.col("g.instance").alias("instance"), F.col("ask").cast("int").alias("round"))
        given = _cut(given)
        here = given.select("split", "instance", (F.col("round") + done).alias("round"))
        got = here if got is None else got.union(here)
        if fits is None:
            break
        done += given.agg(F.max("round")).first()[0] + 1
        left = _cut(left.join(given.select("split"), "split", "left_anti"))
    return wanted.select("split", "instance", F.lit(0).alias("round")).limit(0) if got is None else got


def fifo_splits(splits: DataFrame, major: str, *minor: str) -> DataFrame:
    """``place`` of each split in the queue, from 1, in the order of the columns. Blocks of the whole number ``major`` are
    numbered on their own, after the splits of the blocks before them."""
    rows = splits.withColumn("__b", F.floor(F.col(major) / (1 << 16)))
    counts = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    offsets = counts.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__b").orderBy(major, *minor))
    return rows.withColumn("__at", at).join(offsets, "__b").withColumn("place", F.col("__before") + F.col("__at")).drop("__b", "__before", "__at")


def pack_slices(requests: DataFrame, instance: str, order: str, capacity: dict[str, int]) -> DataFrame:
    """First come, first served slices of each instance: a request is granted if what is left is enough in every dimension
    of ``capacity`` (column to amount), and takes its share then.

    What is left depends on all requests before, so an instance is read by one task: in order, in one pass that holds
    one number for each dimension.
    """
    dims = list(capacity)
    ordered = requests.select(instance, order, *dims).repartition(instance).sortWithinPartitions(instance, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, begun = None, [], False
        for b in batches:
            granted = []
            for k, *wanted in zip(b.column(0).to_pylist(), *[b.column(d).to_pylist() for d in dims], strict=True):
                if not begun or k != key:
                    key, left, begun = k, list(capacity.values()), True
                fits = all(w <= have for w, have in zip(wanted, left, strict=True))
                left = [have - w for w, have in zip(wanted, left, strict=True)] if fits else left
                granted.append(fits)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(granted, pa.bool_())], names=[*b.schema.names, "granted"])

    return ordered.mapInArrow(run, T.StructType([*ordered.schema.fields, T.StructField("granted", T.BooleanType())]))

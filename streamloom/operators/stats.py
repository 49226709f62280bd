"""Statistics that the engine computes over its own measurements."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .numbering import over_last, prefix_sums, upper_median

#: Least number of tasks that many small groups are dealt to.
PARTS = 200


def count_window(df: DataFrame, channel: list[str], seq: str, value: str, n: int) -> DataFrame:
    """Median (upper), min, max, sum, count, oldest and newest of the last ``n`` values of each channel."""
    v = F.col(value)
    out = over_last(df, channel, seq, n, {"__list": F.collect_list(v), "w_min": F.min(v), "w_max": F.max(v), "w_sum": F.sum(v), "w_count": F.count(v), "w_oldest": F.first(v), "w_newest": F.last(v)})
    return out.withColumn("w_median", upper_median(F.col("__list"))).drop("__list")


def stale_values(df: DataFrame, channel: list[str], arrival: str, seq: str, block: int = 1 << 32) -> DataFrame:
    """Values that arrive with a number that isn't above all before them: a window refuses those. ``arrival`` is a whole
    number (ties by ``seq``); blocks of it are windows of their own, to which the greatest number of the earlier blocks
    is added."""
    rows = df.withColumn("__b", F.floor(F.col(arrival) / block))
    tops = rows.groupBy(*channel, "__b").agg(F.max(seq).alias("__top"))
    earlier = Window.partitionBy(*channel).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tops.select(*channel, "__b", F.max("__top").over(earlier).alias("__old"))
    before = Window.partitionBy(*channel, "__b").orderBy(arrival, seq).rowsBetween(Window.unboundedPreceding, -1)
    full = rows.withColumn("__new", F.max(seq).over(before)).join(offsets, [*channel, "__b"])
    return full.where(F.col(seq) <= F.greatest("__new", "__old")).drop("__b", "__new", "__old")


def edge_latency(df: DataFrame, channel: list[str], bucket: Column, latency: Column) -> DataFrame:
    """Mean latency of a channel's tagged records in each reporting interval, by division of whole numbers."""
    return df.withColumns({"bucket": bucket, "__l": latency}).groupBy(*channel, "bucket").agg(F.count("__l").alias("n"), F.sum("__l").alias("total")).where("n > 0").withColumn("latency", F.expr("total div n")).drop("total")


def edge_statistics(sent: DataFrame, channel: list[str], interval_ms: int, time: str, size: str, records: str) -> DataFrame:
    """Of buffers sent (time, bytes, records): Mbit/s, buffer lifetime (whole division), records by buffer and by second
    for each channel and interval with records and buffers."""
    per = sent.withColumn("bucket", F.expr(f"{time} div {interval_ms}")).groupBy(*channel, "bucket").agg(F.sum(size).alias("bytes"), F.count("*").alias("buffers"), F.sum(records).alias("records"))
    seconds = interval_ms / 1000
    return per.where("records > 0 AND buffers > 0").select(
        *channel, "bucket", (F.col("bytes") * 8 / (1e6 * seconds)).alias("mbit_s"), F.expr(f"{interval_ms} div buffers").alias("lifetime_ms"),
        (F.col("records") / F.col("buffers")).alias("records_per_buffer"), (F.col("records") / seconds).alias("records_s"),
    )


def vertex_latency(df: DataFrame, vertex: list[str], bucket: str, time: str, received: str, emitted: str) -> DataFrame:
    """(last emission - first receipt) by records received, for intervals with at least one of each."""
    got, out = F.col(received) > 0, F.col(emitted) > 0
    per = df.groupBy(*vertex, bucket).agg(F.min(F.when(got, F.col(time))).alias("first_in"), F.max(F.when(out, F.col(time))).alias("last_out"), F.sum(received).alias("received"), F.sum(emitted).alias("emitted"))
    return per.where("received >= 1 AND emitted >= 1 AND last_out >= first_in").withColumn("latency", F.expr("(last_out - first_in) div received"))


def latency_by_emissions(df: DataFrame, vertex: str, seq: str, time: str, received: str, emitted: str, every: int) -> DataFrame:
    """(vertex, at_ms, received, latency): a vertex measures at each ``every``-th emission the time since its first receipt
    after the last measurement, by the records received since then; then it starts anew. Without a receipt there is no
    value, and the count of emissions starts anew all the same.

    Emissions are counted in blocks of ``seq``, so that a period is a number that each row can work out: the emissions
    before it, by ``every``.
    """
    counted = prefix_sums(df, vertex, seq, emitted, "__upto").withColumn("__period", F.expr(f"(__upto - {emitted}) div {every}"))
    got = F.col(received) > 0
    per = counted.groupBy(vertex, "__period").agg(F.min(F.when(got, F.col(time))).alias("first_in"), F.max(F.when(F.col(emitted) > 0, F.struct("__upto", F.col(time).alias("t")))).alias("last"), F.sum(received).alias("received"))
    due = per.where((F.col("last.__upto") == (F.col("__period") + 1) * every) & (F.col("received") > 0))
    return due.select(vertex, F.col("last.t").alias("at_ms"), "received", F.expr("(last.t - first_in) div received").alias("latency"))


def merged_mean(df: DataFrame, keys: list[str], reporter: str, value: Column) -> DataFrame:
    """Unweighted mean of what the reporters have reported, which are means of their own, and their number."""
    own = df.groupBy(*keys, reporter).agg(F.avg(value).alias("__own"))
    return own.groupBy(*keys).agg(F.avg("__own").alias("mean"), F.count("*").alias("reports"))


def last_report(df: DataFrame, keys: list[str], seq: str, *values: str) -> DataFrame:
    """Edge statistics of one key are never merged: the last report wins."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(seq)).alias("__last")).select(*keys, "__last.*")


def path_summary(paths: DataFrame, keys: list[str], latencies: str, intervals: DataFrame) -> DataFrame:
    """Of each row of ``intervals`` (the keys): number of active paths, mean, least and largest total of their elements'
    ``latencies``, and the mean of each element. Without an active path there are zeros, and no means by element."""
    total = F.aggregate(latencies, F.lit(0).cast("long"), lambda a, x: a + x)
    per = paths.withColumn("__t", total).groupBy(*keys).agg(F.count("*").alias("paths"), F.avg("__t").alias("avg_ms"), F.min("__t").alias("min_ms"), F.max("__t").alias("max_ms"))
    elements = paths.select(*keys, F.posexplode(latencies).alias("at", "l")).groupBy(*keys, "at").agg(F.avg("l").alias("l"))
    by_element = elements.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "l"))), lambda x: x["l"]).alias("elements"))
    return intervals.join(per, keys, "left").join(by_element, keys, "left").fillna(0, ["paths", "avg_ms", "min_ms", "max_ms"])


def split_edge_latency(latency: Column, lifetime: Column) -> tuple[Column, Column]:
    """Of an edge's latency: waiting in an output buffer (half its lifetime), and what is left for transport."""
    waiting = lifetime / 2
    return waiting, F.greatest(F.lit(0.0), latency - waiting)


def counter_shares(df: DataFrame, instance: str, order: str, counters: list[str]) -> DataFrame:
    """Share of each counter's growth since the last sample in that of all, in whole percent; the growth itself where
    nothing has grown. The first sample of an instance gives none."""
    w = Window.partitionBy(instance).orderBy(order)
    grown = df.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in counters}).where(F.col(f"d_{counters[0]}").isNotNull())
    total = sum((F.col(f"d_{c}") for c in counters[1:]), F.col(f"d_{counters[0]}"))
    return grown.withColumn("__t", total).withColumns({f"p_{c}": F.when(F.col("__t") == 0, F.col(f"d_{c}")).otherwise(F.expr(f"d_{c} * 100 div __t")) for c in counters}).drop("__t")


def thread_shares(df: DataFrame, task: str, thread: str, order: str, times: list[str], clock: str) -> DataFrame:
    """Whole percent of the interval that a task's threads spent in each state, the integer mean over its threads;
    threads for which no time has passed don't count."""
    w = Window.partitionBy(task, thread).orderBy(order)
    grown = df.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in times} | {"d_clock": F.col(clock) - F.lag(clock).over(w)}).where("d_clock > 0")
    per = grown.withColumns({f"p_{c}": F.expr(f"d_{c} * 100 div d_clock") for c in times})
    return per.groupBy(task, order).agg(F.count("*").alias("threads"), *[F.sum(f"p_{c}").alias(f"s_{c}") for c in times]).select(task, order, "threads", *[F.expr(f"s_{c} div threads").alias(f"p_{c}") for c in times])


def cluster_summary(df: DataFrame, round_: str, instance: str, metrics: list[str], expected: int) -> DataFrame:
    """Integer mean of each metric over all instances, for rounds in which at least the expected number has reported.

    An instance's reports of a round are summed first, in as many tasks as ``in_parts`` makes, so that none holds many."""
    own = in_parts(df.select(round_, instance, *metrics), instance, round_).groupBy(round_, instance).agg(F.count("*").alias("__k"), *[F.sum(m).alias(f"__{m}") for m in metrics])
    per = own.groupBy(round_).agg(F.count(instance).alias("instances"), F.sum("__k").alias("__n"), *[F.sum(f"__{m}").alias(f"__{m}") for m in metrics])
    return per.where(F.col("instances") >= expected).select(round_, "instances", *[F.expr(f"__{m} div __n").alias(m) for m in metrics])


def in_parts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` to ``PARTS`` tasks at least, which aren't merged afterwards: groups of the keys are
    summed there, and what one task holds stays small."""
    return df.repartition(max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def nested_load(df: DataFrame, task: str, seq: str, load: Column, n: int = 5) -> DataFrame:
    """Mean of a task's last ``n`` loads."""
    return over_last(df.withColumn("__load", load), [task], seq, n, {"load_mean": F.avg("__load")}).drop("__load")


def fixed_buffers(df: DataFrame, channel: list[str], record_bytes: int, limit: int) -> DataFrame:
    """Buffers that a channel of equal records ships: each once its bytes (with 4 for the length of each record) reach
    the limit after a whole record; the rest at the end."""
    per = -(-limit // (record_bytes + 4))
    return df.groupBy(*channel).agg(F.count("*").alias("records")).withColumns({"full_buffers": F.expr(f"records div {per}"), "rest_records": F.col("records") % per})


def adaptive_buffers(df: DataFrame, channel: str, seq: str, size: str, limit: int) -> DataFrame:
    """(channel, buffer, last_seq, bytes, records): the same for records of any size.

    Where a buffer ends depends on all records before it, so a channel is read by one task: in order, in one pass that
    holds three numbers.
    """
    ordered = df.select(channel, F.col(seq).cast("long").alias("seq"), (F.col(size) + 4).cast("long").alias("bytes")).repartition(channel).sortWithinPartitions(channel, "seq")
    names = [channel, "buffer", "last_seq", "bytes", "records"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, held, n, number, begun = None, None, 0, 0, 0, False
        for b in batches:
            out: list[tuple] = []
            for k, s, z in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if not begun or k != key:
                    if n:
                        out.append((key, number, last, held, n))
                    key, held, n, number, begun = k, 0, 0, 0, True
                last, held, n = s, held + z, n + 1
                if held >= limit:
                    out.append((key, number, last, held, n))
                    held, n, number = 0, 0, number + 1
            yield made(out)
        if n:
            yield made([(key, number, last, held, n)])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    types = [to_arrow_type(df.schema[channel].dataType), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return ordered.mapInArrow(run, T.StructType([df.schema[channel], *[T.StructField(c, T.IntegerType() if c == "buffer" else T.LongType()) for c in names[1:]]]))

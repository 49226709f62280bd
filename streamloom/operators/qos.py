"""Quality of service: state of edges and vertices, path latencies, violations, and what to change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .numbering import over_last, prefix_sums

#: Window of the state, band of tolerated deviation, and the rules for buffer sizes.
STATE_WINDOW, BAND = 4, 0.05
SHRINK_ABOVE_MS, SHRINK_BASE, LEAST_FACTOR, LEAST_SIZE, SHRINK_UNDER = 5, 0.95, 0.01, 50, 0.98
GROW_UP_TO_MS, GROW_FACTOR, GROW_STEP = 1, 1.2, 100
MERGE_CPU, SPLIT_CPU = 91.0, 99.0
FIRST_ADJUSTMENT_MS = 30_000


def latest_state(df: DataFrame, key: str, seq: str, values: list[str], n: int = STATE_WINDOW) -> DataFrame:
    """Mean of the last ``n`` values of each measure and key; -1 for a measure without any."""
    last = over_last(df, [key], seq, n, {f"mean_{v}": F.avg(v) for v in values})
    return last.groupBy(key).agg(F.max_by(F.struct(*[f"mean_{v}" for v in values]), F.col(seq)).alias("s")).select(key, *[F.coalesce(F.col(f"s.mean_{v}"), F.lit(-1.0)).alias(f"mean_{v}") for v in values])


def buffer_lifetime(lifetime: Column, chained: Column) -> Column:
    """A chained edge has no buffer: its lifetime is 0."""
    return F.when(chained, F.lit(0)).otherwise(lifetime)


def model_states(models: DataFrame, expected: DataFrame, announced: DataFrame, model: str, member: str, time: str) -> DataFrame:
    """(model, state, ready_ms): EMPTY before any member has announced itself, SHALLOW while some that are expected have
    not, READY from the last one's announcement on."""
    said = announced.groupBy(model, member).agg(F.min(time).alias("__at"))
    per = models.select(model).distinct().join(expected.select(model, member).distinct(), model, "left").join(said, [model, member], "left")
    counted = per.groupBy(model).agg(F.count(member).alias("__members"), F.count("__at").alias("__have"), F.max("__at").alias("__last"))
    state = F.when(F.col("__have") == 0, "EMPTY").when(F.col("__have") < F.col("__members"), "SHALLOW").otherwise("READY")
    return counted.select(model, state.alias("state"), F.when(state == "READY", F.col("__last")).alias("ready_ms"))


def ready_measurements(measured: DataFrame, members: DataFrame, states: DataFrame, member: str, model: str, time: str) -> DataFrame:
    """Measurements of members whose model is ready, from the time on that it is; earlier ones are dropped."""
    return measured.join(members, member).join(states, model).where((F.col("state") == "READY") & (F.col(time) >= F.col("ready_ms")))


def is_active(latency: Column, lifetime: Column, chained: Column) -> Column:
    """An edge counts if it has a latency and is chained or has a buffer lifetime."""
    return latency.isNotNull() & (chained | lifetime.isNotNull())


def truncated_total(latencies: Column) -> Column:
    """Sum of an array of doubles into a whole number that drops its fraction after every addition."""
    return F.aggregate(latencies, F.lit(0).cast("long"), lambda a, x: (a + x).cast("long"))


def violations(paths: DataFrame, total: str, limit: str) -> DataFrame:
    """Paths whose total is off the limit by over five percent, with the signed excess: too fast ones too."""
    off = F.col(total) - F.col(limit)
    return paths.where(F.abs(off) / F.col(limit) > BAND).withColumn("excess", off)


def resize_buffers(edges: DataFrame, most: int, old: str = "size", lifetime: str = "lifetime", rate: str = "records_s", excess: str = "excess") -> DataFrame:
    """Recommended output buffer sizes for edges on violated paths (``excess`` > 0), with the reason.

    Half the lifetime is the time that records wait. Over 5 ms, and more than the gap between records, the buffer
    shrinks by 0.95 for each ms, to a hundredth or 50 bytes at most, if that takes off more than 2 percent. Up to 1 ms,
    it grows by a fifth, if that is 100 bytes or reaches the most. The gap is 1 / (rate * 1000), not 1000 / rate, as in
    the rule that this follows.
    """
    obl, gap, size = F.col(lifetime) / 2, 1 / (F.col(rate) * 1000), F.col(old)
    smaller = F.greatest(F.lit(LEAST_SIZE), F.floor(size * F.greatest(F.lit(LEAST_FACTOR), F.pow(F.lit(SHRINK_BASE), obl)))).cast("int")
    larger = F.least(F.floor(size * GROW_FACTOR), F.lit(most)).cast("int")
    shrink = (obl > SHRINK_ABOVE_MS) & (obl > gap) & (smaller < size * SHRINK_UNDER)
    grow = (obl <= GROW_UP_TO_MS) & (size < most) & ((larger >= size + GROW_STEP) | (larger == most))
    out = edges.where(F.col(excess) > 0).withColumn("action", F.when(shrink, "shrink").when(grow, "grow"))
    return out.where(F.col("action").isNotNull()).withColumn("new_size", F.when(F.col("action") == "shrink", smaller).otherwise(larger))


def fresh(df: DataFrame, oldest_latency: str, oldest_lifetime: str, changed: str) -> DataFrame:
    """Edges all of whose latencies and lifetimes are from after the last change of their buffer, if there was one."""
    return df.where(F.col(changed).isNull() | ((F.col(oldest_latency) >= F.col(changed)) & (F.col(oldest_lifetime) >= F.col(changed))))


def adjustment_times(df: DataFrame, start: str, end: str, interval: int) -> DataFrame:
    """Times of adjustment: from 30 s after the start, aligned to the interval, on a fixed grid up to the end."""
    first = (F.col(start) + FIRST_ADJUSTMENT_MS) - (F.col(start) + FIRST_ADJUSTMENT_MS) % interval
    return df.withColumn("first", first).where(F.col("first") <= F.col(end)).withColumn("due_ms", F.explode(F.sequence(F.col("first"), F.col(end), F.lit(interval).cast("long")))).drop("first")


def last_n(df: DataFrame, key: str, time: str, n: int = 2) -> DataFrame:
    """Newest ``n`` rows of each key: the history of a buffer's sizes."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).desc()))).where(F.col("rank") <= n)


def anchor_vertices(members: DataFrame, channels: DataFrame) -> DataFrame:
    """Anchor of each constraint (cid, vertex): most distinct instances, then fewest channels on an adjacent edge, then
    the least name, where the model leaves it to chance."""
    spread = members.groupBy("cid", "vertex").agg(F.countDistinct("instance").alias("instances"))
    narrow = channels.groupBy("cid", "vertex").agg(F.min("channels").alias("channels"))
    rank = F.row_number().over(Window.partitionBy("cid").orderBy(F.col("instances").desc(), F.col("channels"), F.col("vertex")))
    return spread.join(narrow, ["cid", "vertex"]).withColumn("rank", rank).where("rank = 1").drop("rank")


def reporters(paths: DataFrame, anchors: DataFrame) -> DataFrame:
    """(cid, manager, element): which elements of paths through an anchor member report to the manager on its instance."""
    through = paths.join(anchors, ["cid", "member"]).select("cid", "path_id", F.col("instance").alias("manager")).distinct()
    return through.join(paths.select("cid", "path_id", F.col("member").alias("element")), ["cid", "path_id"]).select("cid", "manager", "element").distinct()


def candidate_chains(path: DataFrame) -> DataFrame:
    """Runs of two members or more on one instance: a run begins at a member with one way out, and each that follows
    has one way in (path_id, idx, member, instance, one_out, one_in). Gaps and islands over the path."""
    w = Window.partitionBy("path_id").orderBy("idx")
    # A member continues the run before it if it is on the same instance, with one way in, right after a member.
    joins = (F.lag("instance").over(w) == F.col("instance")) & F.col("one_in") & (F.lag("idx").over(w) == F.col("idx") - 1)
    marked = path.withColumn("start", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("run", F.sum("start").over(w))
    runs = marked.groupBy("path_id", "run").agg(F.count("*").alias("n"), F.min_by("one_out", "idx").alias("opens"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "member"))), lambda x: x["member"]), " ").alias("members"))
    return runs.where("n >= 2 AND opens").select("path_id", "members", "n")


def best_merge(chains: DataFrame, most: float = MERGE_CPU, stretch: int = 1 << 18) -> DataFrame:
    """Of each worker's chains (worker, idx, cpu > 0), the contiguous two or more with the largest sum up to ``most``; the
    first of equals.

    On the line of prefix sums (in thousandths), the best run that ends with a chain begins at the first place within ``most`` before
    its end: a window over a range of sums. The line is cut into stretches that overlap by ``most``, so that a worker
    with many chains is spread over tasks, and no pairs are listed.
    """
    p = prefix_sums(chains, "worker", "idx", "cpu", "upto").withColumn("before", F.col("upto") - F.col("cpu"))
    last = F.struct("idx", "upto")
    ends = p.select("worker", F.round(F.col("upto") * 1000).cast("long").alias("at"), F.lit(None).cast("struct<before:double,first:bigint>").alias("begin"), last.alias("end"), F.array(F.floor(F.col("upto") / stretch)).alias("parts"))
    begins = p.select("worker", F.round(F.col("before") * 1000).cast("long").alias("at"), F.struct(F.col("before").cast("double").alias("before"), F.col("idx").cast("long").alias("first")).alias("begin"), F.lit(None).cast(ends.schema["end"].dataType).alias("end"), F.array_distinct(F.array(F.floor(F.col("before") / stretch), F.floor((F.col("before") + most) / stretch))).alias("parts"))
    line = ends.union(begins).withColumn("part", F.explode("parts"))
    near = Window.partitionBy("worker", "part").orderBy("at").rangeBetween(-round(most * 1000), 0)
    runs = line.withColumn("from", F.min("begin").over(near)).where("end IS NOT NULL AND from IS NOT NULL")
    runs = runs.select("worker", F.col("from.first").alias("first"), F.col("end.idx").alias("last"), (F.col("end.upto") - F.col("from.before")).cast(chains.schema["cpu"].dataType).alias("cpu")).where("last > first")
    best = runs.groupBy("worker").agg(F.max_by(F.struct("first", "last", "cpu"), F.struct("cpu", -F.col("first"), -F.col("last"))).alias("b"))
    return best.select("worker", "b.*")


def split_points(chains: DataFrame, most: float = SPLIT_CPU) -> DataFrame:
    """Where to cut chains (chain, idx, cpu) of more than one task that take over ``most``.

    From either end tasks are taken off until the rest is under ``most``, all but one at most. The chain is cut at the
    beginning if the rest there is at least the rest of the other way, else at the end: (chain, side, tasks, rest).
    """
    w = Window.partitionBy("chain")
    up, down = w.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0), w.orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    full = chains.withColumns({"total": F.sum("cpu").over(w), "n": F.count("*").over(w), "head": F.sum("cpu").over(up), "tail": F.sum("cpu").over(down), "k": F.row_number().over(w.orderBy("idx")), "back": F.row_number().over(w.orderBy(F.col("idx").desc()))}).where((F.col("total") > most) & (F.col("n") > 1))

    def side(cut: str, number: str) -> Column:
        """(tasks taken off, rest): the fewest that bring the rest under the limit, or all but one."""
        rest = F.col("total") - F.col(cut)
        return F.min(F.when((F.col(number) < F.col("n")) & ((rest < most) | (F.col(number) == F.col("n") - 1)), F.struct(F.col(number).alias("tasks"), rest.alias("rest"))))

    cuts = full.groupBy("chain").agg(side("head", "k").alias("b"), side("tail", "back").alias("e"))
    first = F.col("b.rest") >= F.col("e.rest")
    return cuts.select("chain", F.when(first, "begin").otherwise("end").alias("side"), F.when(first, F.col("b.tasks")).otherwise(F.col("e.tasks")).alias("tasks"), F.when(first, F.col("b.rest")).otherwise(F.col("e.rest")).alias("rest"))

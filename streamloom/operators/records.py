"""Per-record operators: they work on batch and streaming DataFrames alike unless they number rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered

#: Every so many records of a channel carry a time stamp.
TAG_INTERVAL = 7


def forward(df: DataFrame) -> DataFrame:
    """Emit what was read."""
    return df.select("*")


def grep(df: DataFrame, text: str, needle: str, strict: bool = True) -> DataFrame:
    """Named like a filter, but by default it forwards every record, as its model does; ``strict=False`` filters."""
    return df if strict else df.where(F.col(text).contains(needle))


def map_records(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """User code from none to many records for each one, in Arrow batches."""
    return df.mapInArrow(fn, schema)


def chain(df: DataFrame, *mappers: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Mappers one after the other; Spark runs them in one stage, and rows are never shared between them."""
    return reduce(lambda d, f: f(d), mappers, df)


def fan_out(df: DataFrame, gates: int = 2, gate: str = "gate") -> DataFrame:
    """Each record to each of some output gates."""
    return df.withColumn(gate, F.explode(F.sequence(F.lit(0), F.lit(gates - 1))))


def tag_every(df: DataFrame, channel: list[str], seq: str, now: Column, k: int = TAG_INTERVAL) -> DataFrame:
    """``tag_ts_ms``: the time for the k-th, 2k-th ... record of each channel, null for the others."""
    return numbered(df, channel, seq, "__n").withColumn("tag_ts_ms", F.when(F.col("__n") % k == 0, now)).drop("__n")


def event_positions(df: DataFrame, seq: str, every: int = 1000) -> DataFrame:
    """Records right before which a control event is sent. The sender's counter starts at 1 and is raised before the
    test, so that these are the 999th, 1999th ... record, not the 1000th."""
    return numbered(df, [], seq, "pos").where(F.col("pos") % every == every - 1)


def merge_control(data: DataFrame, control: DataFrame, seq: str) -> DataFrame:
    """Records and control events of one channel in one stream: events keep their place, right before the record of
    their number. ``kind`` is 0 for events and 1 for records."""
    return control.withColumn("kind", F.lit(0)).unionByName(data.withColumn("kind", F.lit(1)), allowMissingColumns=True)


def deliver(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each event to every subscriber of exactly its type, in the order of subscription."""
    return events.join(subscriptions, "event_type")


def sampled_latency(df: DataFrame, seq: str, sent: str, now: str, every: int) -> DataFrame:
    """Latency of the 1st record and each ``every``-th after it."""
    return numbered(df, [], seq, "pos").where((F.col("pos") - 1) % every == 0).withColumn("latency_ms", F.col(now) - F.col(sent))

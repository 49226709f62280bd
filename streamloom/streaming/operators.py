"""Stateful operators and control loops on Structured Streaming.

Everything that needs no order runs on streams as it is: the functions of ``operators.records`` that number no rows, of
``operators.routing`` and the bucketed statistics. What follows keeps state by channel. Rows of a channel must reach it
in the order of ``seq`` over micro-batches; within one, they are sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _by_channel(frames: Iterator[pd.DataFrame], seq: str) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(seq, kind="stable", ignore_index=True)


def count_window(df: DataFrame, channel: str, seq: str, value: str, n: int) -> DataFrame:
    """For each row, upper median, min, max, sum and count of the channel's last ``n`` values; the state is a ring of
    ``n`` values. A number that isn't above the last one raises an error, as the window does that it follows."""
    schema = f"{channel} {df.schema[channel].dataType.simpleString()}, {seq} long, w_median double, w_min double, w_max double, w_sum double, w_count long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ring = state.get if state.exists else (-(2**63), [])
        ring, out = list(ring), []
        for s, v in _by_channel(frames, seq)[[seq, value]].itertuples(index=False):
            if s <= last:
                raise ValueError(f"stale number {s} in channel {key[0]}: {last} was there before")
            last, ring = int(s), [*ring, float(v)][-n:]
            out.append((key[0], last, sorted(ring)[len(ring) // 2], min(ring), max(ring), sum(ring), len(ring)))
        state.update((last, ring))
        yield pd.DataFrame(out, columns=[channel, seq, "w_median", "w_min", "w_max", "w_sum", "w_count"])

    return df.groupBy(channel).applyInPandasWithState(step, schema, "last long, ring array<double>", "append", GroupStateTimeout.NoTimeout)


def tag_every(df: DataFrame, channel: str, seq: str, now: str, k: int = 7) -> DataFrame:
    """(channel, seq, tag_ts_ms): the time for every k-th record of a channel, else null; the state is a counter."""
    schema = f"{channel} {df.schema[channel].dataType.simpleString()}, {seq} long, tag_ts_ms long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        rows = _by_channel(frames, seq)
        at = pd.Series(range(seen + 1, seen + 1 + len(rows)))
        state.update((int(seen + len(rows)),))
        yield pd.DataFrame({channel: key[0], seq: rows[seq], "tag_ts_ms": rows[now].astype("Int64").where(at % k == 0)})

    return df.groupBy(channel).applyInPandasWithState(step, schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def ship_buffers(df: DataFrame, channel: str, seq: str, size: str, limit: int) -> DataFrame:
    """(channel, last_seq, bytes, records) for each full buffer: bytes, with 4 for a record's length, reach the limit after
    a whole record. What is left stays in the state until more comes."""
    schema = f"{channel} {df.schema[channel].dataType.simpleString()}, last_seq long, bytes long, records long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = state.get if state.exists else (0, 0)
        out = []
        for s, b in _by_channel(frames, seq)[[seq, size]].itertuples(index=False):
            held, n = held + int(b) + 4, n + 1
            if held >= limit:
                out.append((key[0], int(s), held, n))
                held, n = 0, 0
        state.update((held, n))
        yield pd.DataFrame(out, columns=[channel, "last_seq", "bytes", "records"])

    return df.groupBy(channel).applyInPandasWithState(step, schema, "held long, n long", "append", GroupStateTimeout.NoTimeout)


def vertex_latency(df: DataFrame, vertex: str, seq: str, time: str, kind: str, interval: int, k: int = 7) -> DataFrame:
    """(vertex, at_ms, latency, received): on every k-th emission that is due, the time since the first receipt by the
    number received (whole division); then counting starts anew and the next report is due an interval later.

    Rows are receipts (``kind`` 'in') and emissions ('out') with a time in ms.
    """
    schema = f"{vertex} {df.schema[vertex].dataType.simpleString()}, at_ms long, latency long, received long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, received, emitted, due = state.get if state.exists else (-1, 0, 0, -1)
        out = []
        for t, what in _by_channel(frames, seq)[[time, kind]].itertuples(index=False):
            t = int(t)
            due = t + interval if due < 0 else due
            if what == "in":
                first, received = (t if received == 0 else first), received + 1
                continue
            emitted += 1
            if emitted % k == 0 and received >= 1 and t >= due:
                out.append((key[0], t, (t - first) // received, received))
                first, received, emitted, due = -1, 0, 0, t + interval
        state.update((first, received, emitted, due))
        yield pd.DataFrame(out, columns=[vertex, "at_ms", "latency", "received"])

    return df.groupBy(vertex).applyInPandasWithState(step, schema, "first long, received long, emitted long, due long", "append", GroupStateTimeout.NoTimeout)


def ready_measurements(measured: DataFrame, announced: DataFrame, key: str, time: str) -> DataFrame:
    """Measurements of a model that is ready: those of announced members, from the time on that all its members were
    (``announced``: key, model, ready_ms). Earlier ones are dropped."""
    return measured.join(announced, key).where(F.col(time) >= F.col("ready_ms")).drop("ready_ms")


def control_loop(measured: DataFrame, decide: Callable[[DataFrame], DataFrame], actions: str, checkpoint: str, once: bool = True):
    """Run ``decide`` on each micro-batch and add its rows to the table of actions at a path, one folder for each batch,
    so that a batch that is run again replaces its own rows. Returns the query."""
    def write(batch: DataFrame, number: int) -> None:
        decide(batch).write.mode("overwrite").parquet(f"{actions}/batch={number}")

    writer = measured.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Sharding: documents into contiguous shards of near equal bytes that keep equal texts together."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Bytes that each document takes besides its text.
OVERHEAD = 16
#: Ranges of digests that one look at the groups returns at most (about).
UNITS = 1 << 14
#: Rows that one task numbers within a shard, on average, even if all rows were in one shard.
ROWS_PER_BIN = 200_000


@dataclass
class Unit:
    """Consecutive groups: those whose digest lies in [low, high). One group only: nothing can be cut inside."""

    low: int
    high: int
    size: int
    groups: int
    #: Upper bits of the digests in it, as many as were looked at when it was made.
    cell: int


def _cuts(units: list[Unit], shards: int, capacity: int, divisible: bool) -> list[int] | None:
    """Greedy check: ends of shards as bytes from the start, or None if ``shards`` of ``capacity`` don't suffice.

    ``divisible``: as if a unit of several groups could be cut anywhere, which no true cut can beat.
    """
    ends = [0]
    for u in units:
        ends.append(ends[-1] + u.size)
    total, at, out = ends[-1], 0, []
    while at < total:
        if len(out) == shards:
            return None
        limit = at + capacity
        k = bisect_right(ends, limit) - 1
        to = ends[k]
        if divisible and k < len(units) and units[k].groups > 1:
            to = limit
        if to <= at:
            return None
        out.append(min(to, total))
        at = to
    return out


def _least(units: list[Unit], shards: int, divisible: bool) -> int:
    """Binary search for the smallest feasible capacity."""
    total = sum(u.size for u in units)
    low, high = -(-total // shards), max(total, 1)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _cuts(units, shards, mid, divisible) is not None else (mid + 1, high)
    return low


def _greedy_trace(units: list[Unit], shards: int, capacity: int, divisible: bool) -> list[int]:
    """As ``_cuts``, but going on after ``shards`` cuts are not enough: the places of the first ``shards`` cuts."""
    ends = [0]
    for u in units:
        ends.append(ends[-1] + u.size)
    at, out = 0, []
    for _ in range(shards):
        k = bisect_right(ends, at + capacity) - 1
        to = ends[k]
        if divisible and k < len(units) and units[k].groups > 1:
            to = at + capacity
        at = min(max(to, at), ends[-1])
        out.append(at)
    return out


def _open_units(units: list[Unit], shards: int, low: int, high: int) -> list[int]:
    """Units of several groups in which a cut may fall for some capacity from ``low`` to ``high``."""
    early, late = _greedy_trace(units, shards, low, False), _greedy_trace(units, shards, high, True)
    spans, out, at = list(zip(early, late, strict=True)), [], 0
    for k, u in enumerate(units):
        if u.groups > 1 and any(a < at + u.size and b > at for a, b in spans):
            out.append(k)
        at += u.size
    return out


def plan_shards(groups: DataFrame, shards: int) -> list[int]:
    """First digest of each shard but the first, for ``groups`` (digest, size, rows).

    Only sums over cells of digests reach the driver, at most about ``UNITS`` at a time. Cells in which a cut may fall
    are divided by further bits and summed again by Spark, until the smallest capacity and its cuts are exact for
    single groups. As capacities are narrowed down, a cell that no cut can reach is out of reach for good, so that the
    cells to divide are always those of the last round.
    """
    def look(rows: DataFrame, bits: int) -> list[Unit]:
        found = rows.groupBy(F.shiftright("digest", 64 - bits).alias("cell")).agg(F.min("digest"), F.max("digest"), F.sum("size"), F.count("*"))
        return [Unit(int(r[1]), int(r[2]) + 1, int(r[3]), int(r[4]), int(r[0])) for r in found.collect()]

    bits = UNITS.bit_length() - 1
    units = sorted(look(groups, bits), key=lambda u: u.low)
    while True:
        low, high = _least(units, shards, True), _least(units, shards, False)
        marked = _open_units(units, shards, low, high)
        if not marked:
            break
        cells = groups.sparkSession.createDataFrame([(units[k].cell,) for k in marked], "cell long")
        near = groups.join(F.broadcast(cells), F.shiftright("digest", 64 - bits) == F.col("cell")).drop("cell")
        bits = min(64, bits + max(1, min(10, (UNITS // len(marked)).bit_length() - 1)))
        gone = set(marked)
        units = sorted([u for k, u in enumerate(units) if k not in gone] + look(near, bits), key=lambda u: u.low)
    cuts, starts, at = _cuts(units, shards, high, False) or [], [], 0
    ends = set(cuts[:-1])
    for u in units:
        if at in ends:
            starts.append(u.low)
        at += u.size
    return starts


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put each row into one of ``shards`` shards of near equal bytes; rows with equal texts share a shard.

    Law ``bytes``: groups of equal texts, in the order of a 64-bit digest, are the atoms of a minimax contiguous
    partition: no split of that order has a smaller largest shard. Size: UTF-8 bytes of the text (null: none) plus
    ``OVERHEAD``. Null and empty texts make one group; an empty table gives no rows; repeated rows each get a slot.
    ``slot`` numbers the rows of a shard from 0 without gaps: rows are counted by (shard, bin), bins get offsets,
    and each bin is numbered on its own, so no task sees a whole shard. Other columns of ``docs`` are not carried.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(F.col(id_col), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("digest")))
    groups = cut(rows.groupBy("digest").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    starts = plan_shards(groups, shards)
    n = int(groups.agg(F.sum("rows")).first()[0] or 0)
    bins = max(1, -(-n // ROWS_PER_BIN))
    shard = F.lit(0)
    for s in starts:
        shard = shard + (F.col("digest") >= F.lit(s)).cast("int")
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("bin", F.pmod(F.xxhash64(id_col, "digest", F.lit(7)), F.lit(bins)).cast("int"))
    counts = placed.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bin")) - F.col("n")).drop("n")
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "bin").orderBy(id_col, "digest", "size")))
    return numbered.join(before, ["shard", "bin"]).select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

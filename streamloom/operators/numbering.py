"""Positions and count windows in ordered channels, without putting a hot channel into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sequence numbers in one block of a channel, and rows in one block of a count window.
BLOCK = 1 << 18


def numbered(df: DataFrame, keys: list[str], seq: str, name: str = "pos", block: int = BLOCK) -> DataFrame:
    """``df`` with the position (from 1) of each row in its channel ``keys``, in the order of the whole number ``seq``.

    Rows are numbered within (channel, block of sequence numbers); the rows of a channel's earlier blocks are counted
    apart. Ties keep no promised order. Without keys all rows are one channel.
    """
    own = [*keys, "__block"]
    rows = df.withColumn("__block", F.floor(F.col(seq) / block))
    counts = rows.groupBy(*own).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    inside = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*own).orderBy(seq)))
    return inside.join(offsets, own).withColumn(name, F.col("__before") + F.col("__at")).drop("__block", "__before", "__at")


def prefix_sums(df: DataFrame, key: str, seq: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """``name``: sum of ``value`` over a key's rows up to and with each one, in the order of the whole number ``seq``.
    Blocks of ``seq`` are summed on their own and the sums of earlier blocks are added, so that a hot key is spread."""
    rows = df.withColumn("__block", F.floor(F.col(seq) / block))
    totals = rows.groupBy(key, "__block").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "__block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(key, "__block").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__in", F.sum(value).over(inside)).join(offsets, [key, "__block"]).withColumn(name, F.col("__before") + F.col("__in")).drop("__block", "__before", "__in")


def over_last(df: DataFrame, keys: list[str], seq: str, n: int, columns: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """``df`` with ``columns``: aggregates over the last ``n`` rows of the channel, up to and with the row itself.

    A channel is cut into blocks of positions, no smaller than ``n``; each block also gets the ``n - 1`` rows before
    it, so that blocks are windows of their own.
    """
    block = max(block, n)
    rows = numbered(df, keys, seq, "__pos", block).withColumn("__b", F.floor((F.col("__pos") - 1) / block)).withColumn("__halo", F.lit(False))
    edge = rows.where((F.col("__pos") - 1) % block > block - n).withColumns({"__b": F.col("__b") + 1, "__halo": F.lit(True)})
    frame = Window.partitionBy(*keys, "__b").orderBy("__pos").rowsBetween(-(n - 1), 0)
    full = rows.unionByName(edge).withColumns({c: x.over(frame) for c, x in columns.items()})
    return full.where(~F.col("__halo")).drop("__pos", "__b", "__halo")


def upper_median(values: Column) -> Column:
    """Element number size // 2 (from 0) of the sorted values, from a collected list; no averaging."""
    return F.get(F.sort_array(values), (F.size(values) / 2).cast("int"))

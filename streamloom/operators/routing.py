"""Routing: which consumer gets which record, and how vertices are wired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered


def round_robin(df: DataFrame, producer: list[str], seq: str, n: int, channel: str = "channel") -> DataFrame:
    """The k-th record (from 1) of a producer goes to channel k % n: the counter is raised before it is used."""
    return numbered(df, producer, seq, "__k").withColumn(channel, (F.col("__k") % n).cast("int")).drop("__k")


def select_channels(df: DataFrame, selector: Column, n: int, channel: str = "channel") -> DataFrame:
    """One copy of each record for each channel that ``selector``, an array, names; null drops the record, and channels
    that don't exist are passed over."""
    return df.withColumn(channel, F.explode(selector)).where((F.col(channel) >= 0) & (F.col(channel) < n))


def by_key(df: DataFrame, key: Column, n: int, channel: str = "channel") -> DataFrame:
    """Records of equal keys to one channel, by a hash that any engine can compute: the first 32 bits of
    the md5 of the key as text."""
    return df.withColumn(channel, (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % n).cast("int"))


def broadcast_to(df: DataFrame, consumers: int, consumer: str = "consumer") -> DataFrame:
    """Every record to every consumer."""
    return df.withColumn(consumer, F.explode(F.sequence(F.lit(0), F.lit(consumers - 1))))


def wire(edges: DataFrame) -> DataFrame:
    """Member edges of vertex edges (``m`` sources, ``n`` targets, ``pattern``): ``i`` to ``j``.

    BIPARTITE: all to all. POINTWISE: of fewer sources, i feeds the targets j with j % m = i; else i feeds i % n. Only
    the targets of each source are made, so that pointwise edges stay linear.
    """
    i = edges.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    every = F.sequence(F.lit(0), F.col("n") - 1)
    strided = F.when(F.col("m") < F.col("n"), F.sequence(F.col("i"), F.col("n") - 1, F.col("m"))).otherwise(F.array(F.col("i") % F.col("n")))
    return i.withColumn("j", F.explode(F.when(F.col("pattern") == "BIPARTITE", every).otherwise(strided)))


def union_streams(*streams: DataFrame) -> DataFrame:
    """All records of two or more streams of the same kind; nothing is removed."""
    if len(streams) < 2:
        raise ValueError("a union needs two streams at least")
    out = streams[0]
    for s in streams[1:]:
        if s.schema != out.schema and [f.dataType for f in s.schema] != [f.dataType for f in out.schema]:
            raise ValueError("streams of a union have one type")
        out = out.unionByName(s)
    return out


def concat_in_order(*streams: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """All of the first stream, then all of the second: ``ordinal`` says which, to order by."""
    return union_streams(*[s.withColumn(ordinal, F.lit(k)) for k, s in enumerate(streams)])


def fair_order(df: DataFrame, channel: str, seq: str) -> DataFrame:
    """Order in which a reader takes records that are all there, one of each channel in turn: (``turn``, channel)."""
    return numbered(df, [channel], seq, "turn")


def topology_distance(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Hops between two nodes of a tree, given as paths from the root: up to the common ancestor and down again."""
    x, y = F.split(a, "/"), F.split(b, "/")
    both = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    common = F.aggregate(both, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    return pairs.withColumn("distance", F.size(x) + F.size(y) - 2 * common)

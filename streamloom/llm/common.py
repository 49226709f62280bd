"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, newline, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a regular expression for Java.
SPACE_RE = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast only if it has been counted and has at most this many rows.
BROADCAST_ROWS = 200_000
#: Keys that meet more rows than this are joined by broadcasting the other side's row.
HOT = 20_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which driver and executors share.

    Only where that is unset and the session is a local one, as in tests, a temporary folder takes its place.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so that its lineage ends here."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows; call it on something cheap to count, such as ``cut(...)``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_once(rows: DataFrame, table: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``table``, which has one row for each ``key`` and says in ``size`` how many rows
    that one meets; ``size`` is dropped.

    A small table is broadcast. Of a large one, the keys with over ``HOT`` rows are, of which there are few, and the others
    meet their rows by a shuffle: no task gets all rows of a hot key.
    """
    table = cut(table)
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how).drop(size)
    hot = table.where(F.col(size) > HOT)
    if hot.isEmpty():
        return rows.join(table, key, how).drop(size)
    spread = rows.join(small(hot), key)
    rest = rows.join(small(hot.select(key)), key, "left_anti").join(table.where(F.col(size) <= HOT), key, how)
    return spread.unionByName(rest).drop(size)


def words_of(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RE), lambda w: w != "")


def shingles_of(words: Column, k: int) -> Column:
    """xxhash64 of every run of ``k`` words, in order; none if there are fewer."""
    return F.when(
        F.size(words) >= k,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - (k - 1)),
            lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(k)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves remainder 2 of 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that a result is about to define anew."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])

"""Sources and sinks of lines, whole files and generated records."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a generated record.
RECORD_BYTES = 128
#: Bytes of files that a task hands on at once.
READ_BYTES = 8 << 20


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines end with a line feed; one carriage return before it is taken off, others are data; empty lines stay."""
    reader = spark.readStream if streaming else spark.read
    return reader.option("lineSep", "\n").text(path).select(F.regexp_replace("value", r"\r\z", "").alias("value"))


def explode_lines(df: DataFrame, text: str, line: str = "value", number: str = "line_no") -> DataFrame:
    """Lines of a text column by the same rules, numbered from 0; what follows the last line feed counts if not empty."""
    parts = F.split(text, "\n", -1)
    parts = F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return df.select(*[c for c in df.columns if c != text], F.posexplode(parts).alias(number, line)).withColumn(line, F.regexp_replace(line, r"\r\z", ""))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (file_name, content), never in fragments. Spark's source passes over empty files."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")


def distinct_files(files: DataFrame) -> DataFrame:
    """File records are equal if their bytes are, whatever their names: the least name of each content."""
    return files.groupBy("content").agg(F.min("file_name").alias("file_name"))


def generate(spark: SparkSession, n: int, producers: int = 1) -> DataFrame:
    """Numbered splits: ``n`` records in as many partitions as producers."""
    return spark.range(0, n, 1, producers)


def counting_records(spark: SparkSession, n: int, task: str) -> DataFrame:
    return generate(spark, n).select("id", F.concat(F.lit("Record "), F.col("id"), F.lit(f" of {task}")).alias("value"))


def records_for(gigabytes: int, subtasks: int) -> int:
    """Records of RECORD_BYTES that one of some subtasks sends, for so many gigabytes in all. Python's whole numbers
    don't overflow, so large shares are right too."""
    return gigabytes * 1024 // subtasks * 1024 * 1024 // RECORD_BYTES


def fixed_size_records(spark: SparkSession, n: int) -> DataFrame:
    """Records whose byte i is i % 128."""
    return generate(spark, n).select("id", F.unhex(F.lit(bytes(i % 128 for i in range(RECORD_BYTES)).hex())).alias("payload"))


def stamped_records(df: DataFrame, seq: str, now: Column, every: int = 100_000) -> DataFrame:
    """``ts_ms``: the time read at the latest record whose number is a multiple of ``every``; ``seq`` counts from 0.

    The stamp is joined from those few records, so that no order over all rows is needed.
    """
    own = df.withColumn("__slot", (F.col(seq) - F.col(seq) % every))
    marks = own.where(F.col(seq) % every == 0).select(F.col(seq).alias("__slot"), now.alias("ts_ms"))
    return own.join(marks, "__slot").drop("__slot")


def plan_splits(files: DataFrame, min_splits: int) -> DataFrame:
    """Splits (file, split_no, start, length) of files (file, len, block).

    The size of a split is the least of the block and the total length by the number of splits, at least 1; cutting
    goes on while more than 1.1 sizes remain; an empty file gives one empty split.
    """
    total = files.agg(F.ceil(F.sum("len") / F.lit(min_splits)).cast("long").alias("most"))
    sized = files.join(F.broadcast(total)).withColumn("size", F.greatest(F.lit(1), F.least("most", "block")))
    # n whole cuts leave a rest of at most 1.1 sizes: the least n with len - n * size <= 1.1 * size.
    cuts = F.greatest(F.lit(0), F.ceil((F.col("len") * 10 - F.col("size") * 11) / (F.col("size") * 10))).cast("long")
    each = sized.withColumn("cuts", cuts).withColumn("split_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts"))))
    length = F.when(F.col("split_no") < F.col("cuts"), F.col("size")).otherwise(F.col("len") - F.col("cuts") * F.col("size"))
    return each.select("file", "split_no", (F.col("split_no") * F.col("size")).alias("start"), length.alias("length"))


def split_hosts(splits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Block (file, block_no, block_start, block_len) of each split: the one that holds its start, or the next if less
    than half of the split's length is left in it."""
    w = Window.partitionBy("file").orderBy("block_no")
    following = blocks.withColumn("next_no", F.lead("block_no").over(w))
    at = splits.join(following, "file").where((F.col("start") >= F.col("block_start")) & (F.col("start") < F.col("block_start") + F.col("block_len")))
    short = F.col("block_start") + F.col("block_len") - F.col("start") < F.floor(F.col("length") / 2)
    return at.select("file", "split_no", "start", "length", F.when(short, F.coalesce("next_no", "block_no")).otherwise(F.col("block_no")).alias("host_block"))


def write_lines(df: DataFrame, path: str, text: str = "value") -> None:
    """Each record followed by carriage return and line feed; what is there is replaced."""
    df.select(F.col(text).alias("value")).write.option("lineSep", "\r\n").mode("overwrite").text(path)


def _mounted(folder: str) -> str:
    """Path of a folder that all executors mount; it may be given as a ``file:`` URI."""
    parts = urlsplit(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{folder} is no folder that executors mount")
    return unquote(parts.path) if parts.scheme else folder


def write_files(files: DataFrame, folder: str, spread: int = 0) -> None:
    """Each (file_name, content) to a file of that name, through the file system of the executors' Hadoop-free path:
    ``folder`` must be one that all executors mount. Names are taken by their last part, so none leads out of it.
    ``spread``: files are dealt by their names to folders 0 to ``spread - 1`` in it, as one folder takes one new file at
    a time; ``read_spread`` reads those."""
    folder = _mounted(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        made = set()
        for b in batches:
            for file_name, content in zip(*[b.column(i).to_pylist() for i in range(2)], strict=True):
                name, own = os.path.basename(file_name), folder
                if spread:
                    own = os.path.join(folder, str(crc32(name.encode()) % spread))
                    if own not in made:
                        os.makedirs(own, exist_ok=True)
                        made.add(own)
                part = os.path.join(own, f".{uuid.uuid4().hex}.part")
                with open(part, "wb") as f:
                    f.write(content or b"")
                os.replace(part, os.path.join(own, name))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    discard(files.select("file_name", F.col("content").cast("binary").alias("content")).mapInArrow(write, "n long"))


def read_spread(spark: SparkSession, folder: str, spread: int) -> DataFrame:
    """``read_files`` of what ``write_files`` has dealt to ``spread`` folders. Tasks list the folders and read the files,
    so that no list of all files is made. As in Spark's source, empty files and those whose names begin with ``.`` or
    ``_`` are passed over."""
    folder = _mounted(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["file_name", "content"])

        names, contents, size = [], [], 0
        for b in batches:
            for k in b.column(0).to_pylist():
                own = os.path.join(folder, str(k))
                if not os.path.isdir(own):
                    continue
                with os.scandir(own) as found:
                    for x in found:
                        if x.name[0] in "._":
                            continue
                        with open(x.path, "rb") as f:
                            content = f.read()
                        if content:
                            names.append(x.name)
                            contents.append(content)
                            size += len(content)
                        if size > READ_BYTES or len(names) >= 1_000:
                            yield batch()
                            names, contents, size = [], [], 0
        yield batch()

    tasks = min(spread, 8 * spark.sparkContext.defaultParallelism)
    return spark.range(0, spread, 1, tasks).mapInArrow(read, "file_name string, content binary")


def count_by_partition(df: DataFrame) -> DataFrame:
    """The counting sink: records that each parallel consumer has seen."""
    return df.groupBy(F.spark_partition_id().alias("subtask")).agg(F.count("*").alias("n"))


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def mebibits_per_second(size: Column, ms: Column) -> Column:
    return size * 8000 / (ms * 1048576)


def megabits_per_second(gigabytes: Column, ms: Column) -> Column:
    return F.floor(gigabytes * 8192 / (ms / 1000) + 0.5).cast("int")

"""The corpus pipeline: quality rules, toxicity, near duplicates, benchmark decontamination, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.bpe import byte_bpe
from streamloom.llm.common import cut, read, shared_folder, small
from streamloom.llm.decontaminate import contaminated_texts
from streamloom.llm.jaccard_join import jaccard_join, text_digest
from streamloom.llm.queries import tokenizer
from streamloom.llm.quality import quality_rules
from streamloom.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity


def _key(*columns: str) -> Column:
    """128 bits for the values of some columns, nulls apart from empty strings."""
    return F.md5(F.concat_ws("\n", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]))


def _spare(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have yet, so that no column of the documents is lost."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; equal texts of a language and source share a verdict, repeated rows too.

    Null, blank and short texts fail; null languages and sources are values of their own; long texts are read whole.
    Other columns are carried along, whatever their names; an empty table stays one.
    """
    key = _spare(docs, "__key")
    rows = docs.withColumn(key, _key("lang", "source", "text"))
    rejected = cut(quality_rules(rows.select("lang", "source", "text", key), keys=(key,)).where(~F.col("kept")).select(key).distinct())
    return rows.join(small(rejected), key, "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the model learns from those that have come this far.

    Null and empty texts get the score of no evidence, repeated rows the same score; without labelled rows the score is
    nearly 0 and all stay. Other columns are carried along; an empty table stays one.
    """
    model, score = fit_toxicity(docs.select("doc_id", "text"), read(spark, sf_dir, "labels")), _spare(docs, "__score")
    return score_toxicity(docs, model, score=score).where(F.col(score) < THRESHOLD).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of exact and near copies, the one of the least id; documents without words stay.

    Of rows that repeat an id and its text one stays; null ids come after all others. Long texts are compared whole.
    Other columns are carried along; an empty table stays one.
    """
    found = jaccard_join(docs.select("doc_id", "text")).where("digest IS NOT NULL").groupBy("doc_id", "digest").agg(F.max("keep").alias("keep"), F.count("*").alias("n"))
    key, digest = _spare(docs, "__key"), _spare(docs, "__digest")
    judged = cut(found.where("NOT keep OR n > 1").select(_key("doc_id", "digest").alias(key), "keep"))
    dropped, repeated = judged.where(~F.col("keep")).select(key), judged.where("keep").select(key)
    rows = docs.withColumn(digest, text_digest(F.col("text"))).withColumn(key, _key("doc_id", digest))
    kept = rows.join(small(dropped), key, "left_anti")
    if not repeated.isEmpty():  # rows that repeat an id and its text: one of them
        several = small(repeated)
        kept = kept.join(several, key, "left_anti").unionByName(kept.join(several, key, "left_semi").dropDuplicates([key]))
    return kept.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; copies of a text share their fate, null and blank texts stay.

    Long texts are searched whole. Other columns are carried along; an empty table stays one, and without benchmark
    items all stay.
    """
    key = _spare(docs, "__digest")
    found = cut(contaminated_texts(docs.select("text"), read(spark, sf_dir, "benchmark")).select(F.col("digest").alias(key)).distinct())
    return docs.withColumn(key, F.md5("text")).join(small(found), key, "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document and a check that they decode to its text; null texts have none. Rows stay rows."""
    coded = byte_bpe(docs.select("doc_id", "text"), *tokenizer())
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.sha2("decoded", 256) == F.sha2(F.coalesce("text", F.lit("")), 256)).alias("round_trip"))


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("byte-level BPE", tokens)]

#: SQL can express neither the fitted models nor the classes of near copies; tests compare with brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; each one's rows are written and read again. What a stage has
    read is removed once its own rows are there."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs

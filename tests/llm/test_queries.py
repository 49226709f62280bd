"""The registered queries: their SQL, their names, and the pipeline against what its stages say."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from streamloom.llm import queries as q


def test_names():
    names = list(q.queries())
    assert [n.split("_")[0] for n in names[:10]] == [f"op{i}" for i in range(1, 11)] and names[10:] == ["pipeline"]


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df, found = q.queries()[name](spark, sf_dir), con.sql(q.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(found.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=key) == sorted(found.select(*[f'"{c}"' for c in cols]).fetchall(), key=key)


def test_pipeline(spark, sf_dir):
    """Each stage on the rows that the one before has left, against the operator's own verdicts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, sf_dir).cache()
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert after.columns == docs.columns and ids <= {r.doc_id for r in left.select("doc_id").collect()}
        if name == "quality rules":
            assert ids == {r.doc_id for r in q.quality_rules(left).where("kept").collect()}
        elif name == "n-gram Jaccard join":
            assert ids == {r.doc_id for r in q.jaccard_join(left).where("keep").collect()}
            assert q.jaccard_join(after).where("class_docs > 1").isEmpty()
        elif name == "benchmark decontamination":
            bad = {r.doc_id for r in q.contamination(left, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert ids == {r.doc_id for r in left.select("doc_id").collect()} - bad
        left = after
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.where("NOT round_trip").isEmpty() and {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in left.select("doc_id").collect()}
    assert out.agg(F.min("n_tokens")).first()[0] > 0


ROWS = [(1, None, "en", "s"), (2, "", "en", "s"), (3, " \n ", None, None), (None, "x " * 80, "fr", "s"), (4, " ".join(f"w{i}" for i in range(60)), "en", "s"), (4, " ".join(f"w{i}" for i in range(60)), "en", "s"), (5, " ".join(f"w{i}" for i in range(60)), "en", "t"), (6, " ".join(f"v{i}" for i in range(30000)), None, "t")]


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_odd_rows(spark, sf_dir, empty):
    """Nulls, blanks, a long text, repeated rows and no rows at all; columns named like the stages' own keep their values."""
    docs = spark.createDataFrame(ROWS[: 0 if empty else None], "doc_id long, text string, lang string, source string")
    for n, c in enumerate(("digest", "__key", "__digest", "__score", "__d", "keep", "kept", "score", "ids", "w", "n", "g")):
        docs = docs.withColumn(c, F.lit(f"mine{n}"))
    own = {r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        rows = after.collect()
        assert after.columns == docs.columns and set(rows) <= own, name
        ids = sorted((r.doc_id or 0) for r in rows)
        if not empty:
            assert ids == {"quality rules": [4, 4, 5], "toxicity": [0, 1, 2, 3, 4, 4, 5, 6], "n-gram Jaccard join": [0, 1, 2, 3, 4, 6], "benchmark decontamination": [0, 1, 2, 3, 4, 4, 5, 6]}[name], name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert out.count() == docs.count() and out.where("NOT round_trip").isEmpty()

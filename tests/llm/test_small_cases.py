"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from streamloom.llm.bpe import byte_bpe
from streamloom.llm.chat import format_chats, loss_text, read_back
from streamloom.llm.decontaminate import contamination
from streamloom.llm.jaccard_join import jaccard_join
from streamloom.llm.language import fit_language, predict_language
from streamloom.llm.licenses import scan_licenses
from streamloom.llm.quality import quality_rules
from streamloom.llm.queries import URL_RULES, tokenizer
from streamloom.llm.shards import shard_documents
from streamloom.llm.toxicity import fit_toxicity, score_toxicity
from streamloom.llm.url_filter import filter_urls

WORDS = [f"w{i}" for i in range(4000)]
LONG = " ".join(WORDS * 10)
ROWS = [(1, "a b c d e f g", "en", "s"), (1, "a b c d e f g", "en", "s"), (None, "a b c d e f g", None, "s"), (2, None, "en", None), (3, "", "fr", "s"), (4, " \n\t ", "fr", "s"), (5, LONG, "en", "s"), (6, "one two", "fr", "t"), (7, "one two", "fr", "t"), (None, None, None, None)]
EXTRA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, EXTRA)
    for c in ("score", "kept", "digest", "ids", "decoded", "shard", "size", "g", "band", "n", "item", "h", "root", "lang_pred", "x0", "host", "rule"):
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x?y"), (2, "http://example.net/enx"), (3, "ftp://x.com://y/"), (4, None), (5, "no url"), (6, "http://net"), (7, "http://notnet.org/fr/"), (7, "http://notnet.org/fr/"), (8, "http://sub.example.com/de/#a"), (9, "://net/" + "d/" * 3000), (10, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"rule": F.lit("old"), "digest": F.lit("x")})
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    got = filter_urls(pages, rules)
    want = {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("org/fr/", "allow"), 8: ("example.com/de/", "block"), 9: ("net/", "block"), 10: (None, "allow")}
    assert got.count() == len(rows) and all((r.rule, r.verdict) == want[r.page_id] for r in got.collect())
    assert {r.host for r in got.where("page_id IN (4, 5, 10)").collect()} == {""} and got.where("page_id = 1").first().host == "a.example.net"
    assert filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
    part = spark.createDataFrame([("a.b/x", "allow"), ("a.b/xy", "block"), ("b", "block")], "rule string, verdict string")
    one = spark.createDataFrame([(1, "h://a.b/xyz"), (2, "h://a.b/xa"), (3, "h://q.a.b/y"), (4, "h://ab/xy")], "page_id long, url string")
    assert {r.page_id: r.rule for r in filter_urls(one, part).collect()} == {1: "a.b/xy", 2: "a.b/x", 3: "b", 4: None}


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "B c D e f"), (2, None), (3, ""), (4, "one TWO"), (5, " ".join(WORDS[:40])), (5, " ".join(WORDS[:40])), (6, "q r s t u v w")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination(docs, items).collect()}
    assert got == {(1, 1), (None, 1), (6, 4), (7, 4), (5, 5)}
    assert contamination(none, items).count() == 0 and contamination(docs, items.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "back\\slash \\l \\q <s>["), (2, 0, "assistant", None), (2, 1, None, "x"), (None, 0, "user", "hi"), (3, 0, "tool [/ROLE] </s>", "é😀"), (3, None, "system", ""), (4, 0, "user", LONG), (4, 0, "user", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    got = {r.conv_id: r for r in format_chats(df).withColumn("turns", read_back(F.col("formatted"))).collect()}
    said = {k: [(t.role, t.text, t.loss) for t in r.turns] for k, r in got.items()}
    assert said[1] == [("user", rows[0][3], False), ("assistant", rows[1][3], True)] and got[1].valid
    assert said[2] == [("assistant", "", True), ("", "x", False)] and not got[2].valid and got[2].bad_turn == 0
    assert said[None] == [("user", "hi", False)] and said[3] == [("system", "", False), ("tool [/ROLE] </s>", "é😀", False)]
    assert said[4] == [("user", LONG, False)] * 2 and got[4].bad_turn == 1
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    masked = {r.conv_id: r.said for r in format_chats(df).select("conv_id", loss_text(F.col("segments")).alias("said")).collect()}
    assert masked == {k: "".join(text for _, text, loss in v if loss) for k, v in said.items()} and masked[1] == rows[1][3]
    assert format_chats(df.limit(0)).count() == 0


def test_join(docs, none):
    got = [tuple(r) for r in jaccard_join(docs).select("doc_id", "class_id", "n_links", "class_docs", "keep").collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = [(1, 1, 0, 3, True), (1, 1, 0, 3, False), (None, 1, 0, 3, False), (2, 2, 0, 1, True), (3, 3, 0, 1, True), (4, 4, 0, 1, True), (5, 5, 0, 1, True), (6, 6, 0, 2, True), (7, 6, 0, 2, False), (None, None, 0, 1, True)]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert jaccard_join(none).count() == 0


def test_shards(spark, docs, none):
    got = shard_documents(docs, 3).collect()
    assert len(got) == len(ROWS) and {r.law for r in got} == {"bytes"}
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.shard for r in got if r.doc_id in (6, 7)}) == 1 and {r.size for r in got if r.doc_id in (2, 3)} == {16}
    assert {r.text_crc32 for r in got if r.doc_id == 6} == {zlib.crc32(b"one two")}
    assert shard_documents(none, 3).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    for model in (fit_toxicity(docs, labels), fit_toxicity(docs, labels.limit(0)), fit_toxicity(none, labels)):
        got = score_toxicity(docs, model)
        assert got.count() == len(ROWS) and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
        assert score_toxicity(none, model).count() == 0
        assert sorted(got.columns) == sorted(docs.columns)


def test_language(docs, none):
    for model in (fit_language(docs), fit_language(none)):
        got = predict_language(docs, model)
        assert {r.lang_pred for r in got.where("text IS NULL OR trim(text) IN ('', '\n\t')").collect()} == {"und"}
        assert got.count() == len(ROWS) and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
        assert predict_language(none, model).count() == 0


def test_licenses(spark, none):
    rows = [(1, "x ALL rights\nreserved. y"), (2, None), (3, ""), (4, "all rights"), (5, LONG + " This work is licensed under the GNU General Public License, version 3. " + LONG), (5, LONG), (None, "all rights reserved.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(1))
    assert sorted(((r.doc_id or 0), r.license, r.containment) for r in scan_licenses(df).collect()) == [(0, "all-rights-reserved", 1.0), (1, "all-rights-reserved", 1.0), (5, "gpl-3.0-short", 1.0)]
    assert scan_licenses(none).count() == 0 and scan_licenses(df, {}).count() == 0


def test_quality(docs, none):
    got = {(r.doc_id, r.n_words): r for r in quality_rules(docs).collect()}
    assert got[(2, 0)].base_failed and not got[(3, 0)].kept and got[(5, 40000)].n_repeat_words == 40000
    assert quality_rules(docs).count() == len(ROWS) and quality_rules(none).count() == 0


def test_quality_of_tiny_sources(spark):
    """Junk of a source or language with few rows is judged by its whole language, or by all rows."""
    plain = lambda i: " ".join(WORDS[(7 * i + j) % 3000] for j in range(60 + i % 40))
    junk = " ".join(f"W{i}!! ##$%" for i in range(60))
    rows = [(i, plain(i), "en", "web") for i in range(600)] + [(1000, junk, "en", "tiny"), (1001, junk, "en", "tiny"), (1002, plain(5), "en", "rare")]
    rows += [(2000, junk, "xx", "tiny"), (2001, plain(9), "yy", "rare")]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, EXTRA)).collect()}
    assert len(got) == len(rows) and not any(r.base_failed for r in got.values())
    assert not any(got[i].kept for i in (1000, 1001, 2000)) and all(got[i].kept for i in (1002, 2001, *range(600)))


def test_bpe(docs, none):
    got = byte_bpe(docs, *tokenizer())
    assert got.count() == len(ROWS) and byte_bpe(none, *tokenizer()).count() == 0
    for r in got.collect():
        assert bytes(r.decoded).decode() == (r.text or "") and (r.ids == []) == (not r.text)
    assert hashlib.sha256(LONG.encode()).hexdigest() == got.where("doc_id = 5").select(F.sha2("decoded", 256)).first()[0]

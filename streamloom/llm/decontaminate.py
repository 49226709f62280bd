"""Benchmark decontamination: item-sized windows, SimHash, Hamming blocks, exact weighted similarity of shingles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shingles_of, small, words_of

WORDS, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, and how many of them may differ. At similarity 0.8 the vectors of two windows have a cosine of
#: 8/9, so that each bit differs with a chance of acos(8/9) / pi = 0.15: over 20 of 64 do with a chance of 2e-4.
BITS, RADIUS = 64, 20
#: Shingles of benchmark items that are broadcast at most; more are joined by shuffling.
BROADCAST_SHINGLES = 1_000_000


def features(sh: Column) -> Column:
    """A hash for each shingle of an array and how many equal ones come before it, so that the members that two arrays
    share are as many as sum(min) of the shingles' weights."""
    def number(ordered: Column) -> Column:
        return F.transform(ordered, lambda h, i: F.xxhash64(h, i + 1 - F.array_position(ordered, h)))

    once = F.transform(sh, lambda h: F.xxhash64(h, F.lit(0).cast("long")))
    # A one-element array binds the sorted shingles, so that they are sorted once.
    return F.when(F.size(F.array_distinct(sh)) == F.size(sh), once).otherwise(F.get(F.transform(F.array(F.sort_array(sh)), number), F.lit(0)))


def fingerprint(f: Column) -> Column:
    """SimHash: bit i is set if more than half of the features have it."""
    def bit(i: int) -> Column:
        have = F.size(F.filter(f, lambda x: F.getbit(x, F.lit(i)) == 1))
        return F.when(2 * have > F.size(f), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long"))

    return reduce(lambda a, b: a.bitwiseOR(b), map(bit, range(BITS)))


def blocks(fp: Column) -> list[Column]:
    """RADIUS + 1 blocks of bits: two fingerprints within the radius agree on one of them."""
    edges = [BITS * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]


def _by_block(rows: DataFrame, fp: str, at: str, bits: str) -> DataFrame:
    return rows.withColumn("__b", F.explode(F.array(*[F.struct(F.lit(i).alias("at"), b.alias("bits")) for i, b in enumerate(blocks(F.col(fp)))]))).select("*", F.col("__b")["at"].alias(at), F.col("__b")["bits"].alias(bits)).drop("__b")


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, k, m, f): the features of each item with words; k = 5 words, or all of a shorter item; m = their number."""
    words = benchmark.select(F.col(item_id).alias("item"), words_of(F.lower(F.col(text))).alias("w")).where(F.size("w") > 0).withColumn("k", F.least(F.lit(WORDS), F.size("w")))
    sh = F.array().cast("array<bigint>")
    for k in range(1, WORDS + 1):
        sh = F.when(F.col("k") == k, shingles_of(F.col("w"), k)).otherwise(sh)
    return words.select("item", "k", sh.alias("sh")).withColumn("m", F.size("sh")).dropDuplicates(["item", "k", "sh"])


def _windows(texts: DataFrame, kinds: list[int]) -> DataFrame:
    """(digest, w, at: (k, m, pos)) to (digest, k, m, sh): item-sized windows that begin at the places ``pos``, or as far
    before them as the text's end demands; a text with fewer shingles is one window."""
    parts = []
    for k in kinds:
        held = texts.select("digest", F.filter("at", lambda a: a["k"] == k).alias("at"), shingles_of(F.col("w"), k).alias("all")).where(F.size("at") > 0)
        starts = F.array_distinct(F.transform("at", lambda a: F.struct(a["m"].alias("m"), F.least(a["pos"], F.greatest(F.size("all") - a["m"], F.lit(0))).alias("start"))))
        windows = held.select("digest", "all", starts.alias("starts")).select("digest", F.explode(F.transform("starts", lambda s: F.struct(s["m"].alias("m"), F.slice("all", s["start"] + 1, s["m"]).alias("sh")))).alias("x"))
        parts.append(windows.select("digest", F.lit(k).alias("k"), F.col("x")["m"].alias("m"), F.col("x")["sh"].alias("sh")))
    return reduce(DataFrame.union, parts)


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(digest, item_id, similarity): distinct texts (by md5) that hold a window like a benchmark item.

    A window has as many words as the item, or all words of a shorter text; its 5-word shingles (all words of a shorter
    item) are a weighted set, by how often they occur. The result has, for each text and item, the best similarity
    sum(min) / sum(max) of at least ``similarity`` among its windows. Words are compared in lower case.

    A window that reaches the similarity shares shingles with its item, and moving it on to its next shared shingle, or
    to the text's end, loses none: so the windows that begin with a shingle of any item of that size are fingerprinted.
    Those within ``RADIUS`` bits of an item of the size meet it in one of ``RADIUS + 1`` blocks, and the exact similarity
    decides. At similarity 0.8 a chance of 2e-4 remains that a window's fingerprint is farther away, and the text's other
    windows may be nearer. Null or blank texts and items match nothing; copies of a text are judged once; a long text has
    as many windows as places with shared shingles; ties of items are all returned; columns of other names are ignored;
    empty tables give no rows.
    """
    items = cut(cut(_items(benchmark, item_id, item_text)).select("item", "k", "m", "sh", features(F.col("sh")).alias("f"), F.monotonically_increasing_id().alias("number")))
    total = items.agg(F.sum("m")).first()[0] or 0
    kinds = sorted(r[0] for r in items.select("k").distinct().collect())  # at most WORDS values
    if not total:
        return docs.select(F.md5(text).alias("digest"), F.lit(None).cast(benchmark.schema[item_id].dataType).alias(item_id), F.lit(0.0).alias("similarity")).limit(0)
    asked = F.broadcast if total <= BROADCAST_SHINGLES else (lambda df: df)
    sizes = items.select("k", "m", F.explode("sh").alias("h")).distinct()
    read = docs.where(F.col(text).isNotNull()).select(F.md5(text).alias("digest"), words_of(F.lower(F.col(text))).alias("w"))
    found = [
        read.select("digest", F.posexplode(shingles_of(F.col("w"), k)).alias("pos", "h")).join(asked(sizes.where(F.col("k") == k).select("h", "m")), "h").select("digest", F.struct(F.lit(k).alias("k"), "m", "pos").alias("at"))
        for k in kinds
    ]
    places = cut(reduce(DataFrame.union, found).groupBy("digest").agg(F.collect_set("at").alias("at")))
    texts = read.join(small(places.select("digest")), "digest", "left_semi").groupBy("digest").agg(F.first("w").alias("w")).join(places, "digest")
    windows = cut(_windows(texts, kinds).select("digest", "k", "m", features(F.col("sh")).alias("f")))

    left = _by_block(windows.select("*", fingerprint(F.col("f")).alias("fp")), "fp", "at", "bits")
    marked = cut(items.select("number", "item", "k", "m", "f", fingerprint(F.col("f")).alias("ifp")))
    right = _by_block(marked.select("number", "k", "m", "ifp"), "ifp", "at", "bits")
    apart = F.col("fp").bitwiseXOR(F.col("ifp"))
    first = reduce(lambda rest, x: F.when(x[1] == 0, F.lit(x[0])).otherwise(rest), reversed(list(enumerate(blocks(apart)))), F.lit(-1))
    # Each pair counts in the first block that it agrees on.
    close = left.join(small(right), ["k", "m", "at", "bits"]).where((F.bit_count(apart) <= RADIUS) & (F.col("at") == first)).select("digest", "m", "f", "number")
    both = F.size(F.array_intersect("f", "other")).cast("double")
    sized = close.join(asked(marked.select("number", "item", F.col("f").alias("other"))), "number").withColumn("both", both).select("digest", "item", (F.col("both") / (F.col("m") + F.size("f") - F.col("both"))).alias("similarity"))
    best = sized.where(F.col("similarity") >= similarity - 1e-9).groupBy("digest", "item").agg(F.max("similarity").alias("similarity"))
    return best.withColumnRenamed("item", item_id)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity) for every row whose text holds a benchmark item; see ``contaminated_texts``. Rows that
    repeat an id and a text are returned as often."""
    found = cut(contaminated_texts(docs, benchmark, text, item_id, item_text))
    rows = docs.select(F.col(doc_id), F.md5(text).alias("__d"))
    return rows.join(small(found), F.col("__d") == F.col("digest")).select(doc_id, item_id, "similarity")

"""N-gram Jaccard self join of documents: MinHash bands find candidates, full sets of word 5-grams decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACES, cut, join_once
from .components import components
from .shingles import minima, mixed, permutations, row_shingles

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999
#: Rows of a band; the number of bands follows from the recall.
ROWS = 6
#: Sets, and shingles in them, in one block of a group (about): two blocks are compared in a task at a time.
SETS, BLOCK = 2_000, 100_000
#: Columns of shared shingles that are multiplied at a time, and rows whose similarities are judged at a time.
COLUMNS, SLAB = 1024, 256
#: Standard deviations that a pair's share of equal minima may lie below the similarity: a chance of 3e-6 to lie lower.
DEVIATIONS = 4.5


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Least number of bands of ``rows`` minima that finds a pair at ``similarity`` with chance ``recall``."""
    b = 1
    while 1 - (1 - similarity**rows) ** b < recall:
        b += 1
    return b


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits for a set, given as its sorted members."""
    with np.errstate(over="ignore"):
        return mixed(shingles).sum(dtype=np.uint64).tobytes() + mixed(~shingles ^ np.uint64(len(shingles))).sum(dtype=np.uint64).tobytes()


def _signatures(docs: DataFrame, bands: int, text: str) -> DataFrame:
    """(digest, sid, bands, sketch) of each text with words: a digest of its text, one of its set of shingles, hashes of its
    bands, and the last byte of each minimum."""
    perms = permutations(bands * ROWS, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            for a, b, shingles, ends in row_shingles(texts, WORDS):
                full = np.flatnonzero(np.diff(ends))
                raw = minima(shingles, ends, perms)[full]
                least = raw.reshape(len(full), bands, ROWS)
                keys = np.full((len(full), bands), 0, np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(ROWS):
                        keys = mixed(keys + least[:, :, r])
                keys ^= mixed(np.arange(1, bands + 1, dtype=np.uint64))
                offsets = np.arange(len(full) + 1, dtype=np.int32) * bands
                sids = [set_key(np.unique(shingles[ends[i] : ends[i + 1]])) for i in full.tolist()]
                sketches = [r.tobytes() for r in (raw & np.uint64(255)).astype(np.uint8)]
                digests = batch.column(0).slice(at, b - a).take(pa.array(full))
                yield pa.RecordBatch.from_arrays([digests, pa.array(sids, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel())), pa.array(sketches, pa.binary())], names=["digest", "sid", "bands", "sketch"])
                at += b - a

    return docs.select(F.md5(text).alias("digest"), text).mapInArrow(run, "digest string, sid binary, bands array<long>, sketch binary")


def _sets(docs: DataFrame) -> DataFrame:
    """(sid, grp, w, text) to (..., held): the sorted set of shingles of each text, as bytes, and their number ``m``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, shingles, ends in row_shingles(batch.column("text").to_pylist(), WORDS):
                sets = [np.unique(shingles[ends[i] : ends[i + 1]]) for i in range(b - a)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("sid"), part.column("grp"), part.column("w"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "grp", "w", "m", "held"])

    return docs.select("sid", "grp", "w", "text").mapInArrow(run, "sid binary, grp binary, w long, m long, held binary")


def linked(x: list[np.ndarray], y: list[np.ndarray], same: bool, similarity: float) -> np.ndarray:
    """Which sets of x and y have the similarity, as a matrix. Shingles of only one set can't be shared and are left out."""
    sizes_x, sizes_y = np.array([len(s) for s in x], float), np.array([len(s) for s in y], float)
    if len(x) * len(y) <= 4:
        common = np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in y] for a in x])
    else:
        sets = x if same else x + y
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        keep = count[inverse] > 1
        col, owner = number[inverse[keep]], owner[keep]
        order = np.argsort(col, kind="stable")
        col, owner = col[order], owner[order]
        common = np.zeros((len(x), len(y)), np.float32)
        m = np.zeros((len(sets), COLUMNS), np.float32)
        for c in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
            a, b = np.searchsorted(col, [c, c + COLUMNS])
            m[owner[a:b], col[a:b] - c] = 1
            for r in range(0, len(x), SLAB):
                common[r : r + SLAB] += m[r : min(r + SLAB, len(x))] @ (m if same else m[len(x) :]).T
            m[owner[a:b], col[a:b] - c] = 0
    out = np.zeros((len(x), len(y)), bool)
    for r in range(0, len(x), SLAB):
        part = common[r : r + SLAB].astype(float)
        out[r : r + SLAB] = part >= similarity * (sizes_x[r : r + SLAB, None] + sizes_y[None, :] - part) - 1e-6
    return out


def alike(x: list[np.ndarray], y: list[np.ndarray], same: bool, least: int) -> np.ndarray:
    """Which sketches of x and y agree in at least so many places, as a matrix."""
    a, b = np.stack(x), np.stack(y)
    if len(a) * len(b) <= 256:
        return (a[:, None, :] == b[None, :, :]).sum(axis=2) >= least
    count = np.zeros((len(a), len(b)), np.uint16)
    for c in range(a.shape[1]):
        count += a[:, c][:, None] == b[:, c][None, :]
    return count >= least


def _compare(pairs: DataFrame, kind: type, judge: Callable[[list, list, bool], np.ndarray]) -> DataFrame:
    """(grp, i, j, side, sid, w, held), sorted by block pair, to (a, b, n): each set that ``judge`` links with another one of
    the block pair, the weight ``n`` of all it is linked with, and a set ``b`` that it hangs together with.

    One row for each set says as much about the classes and numbers of links as a row for each pair would.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            same = key is not None and key[1] == key[2]
            xs, ys = held[0], held[0] if same else held[1]
            if not xs or not ys or (same and len(xs) < 2):
                return
            rows = xs if same else xs + ys
            links = judge([x[2] for x in xs], [y[2] for y in ys], same)
            if same:
                np.fill_diagonal(links, False)
            wx, wy = np.array([x[1] for x in xs]), np.array([y[1] for y in ys])
            counts = links @ wy if same else np.concatenate([links @ wy, wx @ links])
            root, far = np.arange(len(rows)), len(rows)
            while True:  # least number of those that hang together
                new = root.copy()
                right = root[: len(xs)] if same else root[len(xs) :]
                for r in range(0, len(xs), SLAB):
                    at = slice(r, min(r + SLAB, len(xs)))
                    new[at] = np.minimum(new[at], np.where(links[at], right[None, :], far).min(axis=1))
                if not same:
                    for r in range(0, len(ys), SLAB):
                        at = slice(len(xs) + r, len(xs) + min(r + SLAB, len(ys)))
                        new[at] = np.minimum(new[at], np.where(links[:, r : r + SLAB], root[: len(xs), None], far).min(axis=0))
                new = np.minimum(new, new[new])
                if (new == root).all():
                    break
                root = new
            found = np.flatnonzero(counts).tolist()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in found], pa.binary()), pa.array([rows[root[i]][0] for i in found], pa.binary()), pa.array(counts[found].astype(np.int64))], names=["a", "b", "n"])

        for batch in batches:
            for g, i, j, side, sid, w, raw in zip(*[batch.column(c).to_pylist() for c in ("grp", "i", "j", "side", "sid", "w", "held")], strict=True):
                if key != (g, i, j):
                    yield from done()
                    key, held = (g, i, j), ([], [])
                held[side].append((sid, w, np.frombuffer(raw, kind)))
        yield from done()

    return pairs.mapInArrow(run, "a binary, b binary, n long")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """(grp, chunks, sid, w, held), dealt by hash into so many blocks of each group, to a row for each pair of blocks."""
    both = rows.withColumn("c", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = both.select("grp", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") > F.col("o")).cast("int").alias("side"), "sid", "w", "held")
    return pairs.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side", "sid")


def jaccard_classes(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(digest, root, n_links) for each distinct text with words.

    ``digest`` is the text's md5, ``root`` the least key of a set of shingles in its class: texts connected by links.
    ``n_links`` counts the other texts whose sets of 5-word shingles have at least the Jaccard similarity. Texts of one
    to four words have one shingle, all their words.

    Texts with equal sets are one set, which weighs as much as they are. Sets that share a band are compared by sketches
    of their minima, group by group; of a pair at the similarity, a share of 3e-6 falls below what is asked. Sets that
    hang together by such pairs are then compared in full. Groups are split into blocks by hash, every pair of blocks is
    compared in one task, where a product of bit matrices gives all similarities at once, and tasks return one row for
    each set, so that the links of a large group of near copies are counted without being listed.
    """
    bands = bands_for(similarity, recall, ROWS)
    signed = cut(_signatures(docs.where(F.col(text).isNotNull()), bands, text).groupBy("digest").agg(*[F.first(c).alias(c) for c in ("sid", "bands", "sketch")]))
    sets = cut(signed.groupBy("sid").agg(F.min("digest").alias("digest"), F.count("*").alias("w"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    keys = sets.select("sid", F.explode("bands").alias("grp"))
    groups = keys.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / F.lit(float(SETS))).cast("int"))
    asked = join_once(keys, groups, "grp", "n").groupBy("sid").agg(F.collect_list(F.struct("grp", "chunks")).alias("at"))
    sketched = asked.join(sets.select("sid", "w", F.col("sketch").alias("held")), "sid").select("sid", "w", "held", F.explode("at").alias("at")).select("at.grp", "at.chunks", "sid", "w", "held")
    n = bands * ROWS
    least = int(n * similarity - DEVIATIONS * (n * similarity * (1 - similarity)) ** 0.5)
    near = cut(components(_compare(_block_pairs(sketched), np.uint8, lambda x, y, same: alike(x, y, same, least))))

    chosen = near.join(sets.select(F.col("sid").alias("node"), "digest", "w"), "node").select("digest", F.col("node").alias("sid"), F.col("root").alias("grp"), "w")
    few, texts = cut(chosen), docs.select(F.md5(text).alias("digest"), F.col(text).alias("text"))
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # few candidates: other texts stay where they are
        read = texts.join(F.broadcast(few), "digest").groupBy("digest").agg(*[F.first(c).alias(c) for c in ("sid", "grp", "w", "text")])
    else:  # copies of a text become one row in each task before texts are shuffled
        read = texts.groupBy("digest").agg(F.first("text").alias("text")).join(few, "digest")
    full = cut(_sets(read))
    sizes = full.groupBy("grp").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.sum("m") / F.lit(float(BLOCK))), F.ceil(F.count("*") / F.lit(float(SETS)))).cast("int").alias("chunks"))
    links = cut(_compare(_block_pairs(join_once(full, sizes, "grp", "n")), np.uint64, lambda x, y, same: linked(x, y, same, similarity)))
    counts = links.groupBy(F.col("a").alias("sid")).agg(F.sum("n").alias("n"))
    linked_sets = counts.join(components(links).withColumnRenamed("node", "sid"), "sid")
    told = sets.select("sid", "w").join(linked_sets, "sid", "left").select("sid", "w", F.coalesce("root", "sid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    return join_once(signed.select("digest", "sid"), told, "sid", "w").select("digest", "root", "n_links")


def text_digest(text: Column) -> Column:
    """md5 of a text with at least one word, else null."""
    return F.when(F.length(F.translate(F.coalesce(text, F.lit("")), SPACES, "")) > 0, F.md5(text))


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: its id, ``class_id``, ``n_links``, ``class_docs``, ``keep`` and ``digest``.

    ``class_id`` is the least id of all rows whose texts are in the class, copies included; rows without words are
    classes of their own. ``n_links``: other distinct texts linked with this one. ``class_docs``: rows in the class.
    ``keep`` marks one row of each class: the one of the least id (ties by digest; of rows that repeat it, one). Ids may
    be null: they come after all others. Other columns are ignored, an empty table gives no rows. Long texts are hashed
    whole.
    """
    # Rows of one id and text can't be told apart: they are counted, and numbered when they are spread out again.
    rows = cut(docs.select(F.col(doc_id).alias("id"), text_digest(F.col(text)).alias("digest")).groupBy("id", "digest").agg(F.count("*").alias("n")))
    first = F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("digest").alias("d"))).alias("first")
    texts = rows.where("digest IS NOT NULL").groupBy("digest").agg(first, F.sum("n").alias("docs"), F.count("*").alias("met"))
    known = cut(texts.join(jaccard_classes(docs, text, similarity, recall), "digest"))
    classes = known.groupBy("root").agg(F.min("first").alias("best"), F.sum("docs").alias("class_docs"), F.count("*").alias("size")).where("size > 1")
    told = join_once(known, classes, "root", "size", "left").select("digest", F.coalesce("best", "first").alias("best"), F.coalesce("class_docs", "docs").alias("class_docs"), "n_links", "met")
    judged = join_once(rows.where("digest IS NOT NULL"), told, "digest", "met")
    bare = rows.where("digest IS NULL").select("*", F.struct(F.col("id").isNull().alias("z"), "id", F.lit(None).cast("string").alias("d")).alias("best"), F.lit(1).cast("long").alias("class_docs"), F.lit(0).cast("long").alias("n_links"))
    best, own = F.col("best"), F.col("digest").isNull()
    return judged.unionByName(bare).withColumn("at", F.explode(F.sequence(F.lit(1), "n"))).select(
        F.col("id").alias(doc_id),
        best["id"].alias("class_id"),
        "n_links",
        "class_docs",
        (own | ((F.col("at") == 1) & F.col("id").eqNullSafe(best["id"]) & (F.col("digest") == best["d"]))).alias("keep"),
        "digest",
    )

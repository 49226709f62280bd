"""Language identification of code-switched text with a linear-chain conditional random field over words."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import held_out, without

#: Documents of each language to learn from, at most: those with the least hash of their id. Their whole texts are cut
#: into runs of so many words.
DOCS, RUN_WORDS = 120, 20
#: Buckets of hashed features; a word of the lexicon occurs at least so often in the sample.
BUCKETS, LEXICON = 1 << 16, 4
PASSES, BATCH, RATE = 6, 64, 0.2
#: Words that a task remembers, and padded words that are labelled at a time; longer texts are labelled in blocks.
REMEMBERED, CELLS = 150_000, 200_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case; other signs that count as parts of words, such as raised digits, end a run."""
    found = WORD.findall(text.lower())
    if text.isascii():
        return found
    return [w for f in found for w in ([f] if f.isalpha() else "".join(c if c.isalpha() else " " for c in f).split())]


def feature_ids(word: str, lexicon: dict[str, int]) -> list[int]:
    """Affixes up to four characters, inner n-grams of two and three, and the place in the lexicon."""
    w = word
    names = {f"p{w[:n]}" for n in range(1, 5)} | {f"s{w[-n:]}" for n in range(1, 5)} | {f"g{w[i : i + n]}" for n in (2, 3) for i in range(len(w) - n + 1)}
    out = [zlib.crc32(x.encode()) % BUCKETS for x in sorted(names)]
    return out + ([BUCKETS + lexicon[word]] if word in lexicon else [])


@dataclass
class LanguageModel:
    langs: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    start: np.ndarray
    step: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Factors of words for each language, the largest being 1."""
        ids = [feature_ids(w, self.lexicon) for w in words]
        z = np.add.reduceat(self.weights[[i for x in ids for i in x]], np.cumsum([0] + [len(x) for x in ids[:-1]]), axis=0)
        return np.exp(np.maximum(z - z.max(axis=1, keepdims=True), -30))


def forward_backward(e: np.ndarray, sizes: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward vectors, scaled, for sequences side by side, longest first; their products are in
    proportion to the marginals. e: (place, sequence, language), factors; sizes: lengths."""
    n, _, k = e.shape
    live = np.searchsorted(-sizes, -np.arange(1, n + 1), side="right")
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    a = e[0] * start
    alpha[0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, n):
        m = live[t]
        a = (alpha[t - 1, :m] @ step) * e[t, :m]
        alpha[t, :m] = a / a.sum(axis=1, keepdims=True)
    back = np.ascontiguousarray(step.T)
    for t in range(n - 2, -1, -1):
        m = live[t + 1]
        b = (beta[t + 1, :m] * e[t + 1, :m]) @ back
        beta[t, :m] = b / b.sum(axis=1, keepdims=True)
    return alpha, beta


def long_marginals(table: np.ndarray, places: np.ndarray, start: np.ndarray, step: np.ndarray, size: int) -> np.ndarray:
    """Sum of the marginals of one long sequence of words, given as rows of ``table``, with the vectors of one block in
    memory at a time: a first pass keeps what each block begins with, a second one goes back over the blocks."""
    def forward(e: np.ndarray, head: np.ndarray) -> np.ndarray:
        alpha = np.empty_like(e)
        for t in range(len(e)):
            a = head * e[t]
            alpha[t] = a / a.sum()
            head = alpha[t] @ step
        return alpha

    blocks, heads = [places[a : a + size] for a in range(0, len(places), size)], [start]
    for b in blocks[:-1]:
        heads.append(forward(table[b], heads[-1])[-1] @ step)
    total, tail = np.zeros(len(start)), np.ones(len(start))
    for b, head in zip(reversed(blocks), reversed(heads), strict=True):
        e = table[b]
        alpha = forward(e, head)
        for t in range(len(e) - 1, -1, -1):
            p = alpha[t] * tail
            total += p / p.sum()
            tail = step @ (tail * e[t])
            tail /= tail.sum()
    return total


def marginals(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    p = alpha * beta
    return p / np.maximum(p.sum(axis=2, keepdims=True), 1e-300)


def _train(runs: list[tuple[str, list[str]]]) -> LanguageModel:
    """Stochastic gradient of the conditional likelihood over sequences that splice runs of several languages, so that
    the transitions learn how often languages switch and where they go."""
    langs = sorted({lang for lang, _ in runs})
    k, number = len(langs), {lang: i for i, lang in enumerate(langs)}
    counts = Counter(w for _, run in runs for w in run)
    lexicon = {w: i for i, w in enumerate(sorted(w for w, c in counts.items() if c >= LEXICON))}
    known = {w: np.array(feature_ids(w, lexicon)) for w in counts}
    rng = np.random.default_rng(7)
    weights, seen = np.zeros((BUCKETS + len(lexicon), k)), np.full((BUCKETS + len(lexicon), k), 1e-6)
    start, step = np.zeros(k), np.zeros((k, k)) + 2 * np.eye(k)
    start_seen, step_seen = np.full(k, 1.0), np.full((k, k), 1.0)
    for _ in range(PASSES):
        order = rng.permutation(len(runs))
        # Two runs in a row: the same language or two.
        pairs = [order[i : i + 2] for i in range(0, len(order), 2)]
        for at in range(0, len(pairs), BATCH):
            seqs = sorted(([(w, number[runs[r][0]]) for r in p for w in runs[r][1]] for p in pairs[at : at + BATCH]), key=len, reverse=True)
            sizes = np.array([len(s) for s in seqs])
            n, b = sizes.max(), len(seqs)
            ids = [known[w] for s in seqs for w, _ in s]
            gold = np.array([y for s in seqs for _, y in s])
            flat, owner = np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids])
            z = np.stack([np.bincount(owner, weights[flat, c], len(ids)) for c in range(k)], axis=1)
            mask = np.arange(n)[None, :] < sizes[:, None]
            e = np.ones((n, b, k))
            e.transpose(1, 0, 2)[mask] = np.exp(np.maximum(z - z.max(axis=1, keepdims=True), -30))
            s0, s1 = np.exp(start), np.exp(step)
            alpha, beta = forward_backward(e, sizes, s0, s1)
            p = marginals(alpha, beta)
            flat_p = p.transpose(1, 0, 2)[mask]
            d = np.eye(k)[gold] - flat_p
            for c in range(k):
                g = np.bincount(flat, d[owner, c], len(weights))
                seen[:, c] += g * g
                weights[:, c] += RATE * (g - 1e-4 * weights[:, c]) / np.sqrt(seen[:, c])
            y = np.zeros((b, n), int)
            y[mask] = gold
            both = mask[:, 1:]
            joint = (alpha[:-1, :, :, None] * s1 * (e[1:] * beta[1:])[:, :, None, :]).transpose(1, 0, 2, 3)[both]
            g1 = np.zeros((k, k))
            np.add.at(g1, (y[:, :-1][both], y[:, 1:][both]), 1)
            g1 -= (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            g0 = np.bincount(y[:, 0], minlength=k) - p[0].sum(axis=0)
            start_seen += g0 * g0
            step_seen += g1 * g1
            start, step = start + RATE * g0 / np.sqrt(start_seen), step + RATE * g1 / np.sqrt(step_seen)
    return LanguageModel(langs, lexicon, weights, np.exp(start - start.max()), np.exp(step - step.max()))


def fit_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """Learn from text and language of at most ``DOCS`` documents a language whose id is not held out; None if no
    document has both. All words of those texts reach the driver, in short runs. Repeated ids count as one of the bound,
    with all their texts; null ids, texts and languages are left out, so is every other column."""
    usable = docs.where(F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    rank = F.row_number().over(Window.partitionBy(lang).orderBy(F.xxhash64(doc_id), doc_id))
    chosen = usable.select(doc_id, lang).withColumn("__n", rank).where(F.col("__n") <= DOCS).select(F.col(doc_id).alias("__id")).distinct()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = words_of(t.as_py())
                found = [w[s : s + RUN_WORDS] for s in range(0, len(w), RUN_WORDS)]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(found), pa.string()), "words": pa.array(found, pa.list_(pa.string()))})

    picked = usable.join(F.broadcast(chosen), F.col(doc_id) == F.col("__id")).select(lang, text).mapInArrow(runs, "lang string, words array<string>")
    found = sorted((r["lang"], list(r["words"])) for r in picked.collect())
    return _train(found) if found else None


def predict_language(docs: DataFrame, model: LanguageModel | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language that most of the text's words are in, by their mean marginals, and that mean.

    Null texts and texts without a letter get ``und`` and score 0; so do all without a model. Of languages with equal
    means the first by name is taken. Whole texts are labelled, very long ones block by block; rows, repeated ones too,
    and other columns stay as they are, but columns already named like the results are replaced; an empty table gives no
    rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = without(docs, pred, score)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel | None = sent.value
        # Row 0 of the table stands for no word; the others are factors of the words in memory.
        memory: dict[str, int] = {}
        table = np.ones((1024, len(m.langs) if m else 1))
        for b in batches:
            langs, scores = np.zeros(b.num_rows, int), np.zeros(b.num_rows)
            todo: list[tuple[int, np.ndarray]] = []
            for n, t in enumerate(b.column(text)):
                w = words_of(t.as_py() or "") if m else []
                if w:
                    if len(memory) > REMEMBERED:
                        # Rows that wait hold places in the table.
                        _label(m, table, todo, langs, scores)
                        todo, memory = [], {}
                    if fresh := list(set(w).difference(memory)):
                        at = len(memory) + 1
                        memory.update(zip(fresh, range(at, at + len(fresh)), strict=True))
                        while at + len(fresh) > len(table):
                            table = np.concatenate([table, np.ones_like(table)])
                        table[at : at + len(fresh)] = m.emissions(fresh)
                    todo.append((n, np.array(list(map(memory.__getitem__, w)))))
            _label(m, table, todo, langs, scores)
            out = pa.array([m.langs[i] if p > 0 else "und" for i, p in zip(langs, scores, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], out, pa.array(scores)], names=[*names, pred, score])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def _label(m: LanguageModel | None, table: np.ndarray, todo: list[tuple[int, np.ndarray]], langs: np.ndarray, scores: np.ndarray) -> None:
    """Label documents of similar length together, longest first."""
    for i, x in todo:
        if len(x) > CELLS:
            mean = long_marginals(table, x, m.start, m.step, CELLS) / len(x)
            langs[i], scores[i] = mean.argmax(), np.clip(mean.max(), 0, 1)
    todo = sorted([x for x in todo if len(x[1]) <= CELLS], key=lambda x: -len(x[1]))
    at = 0
    while at < len(todo):
        n = len(todo[at][1])
        to = at + 1
        while to < len(todo) and (to + 1 - at) * n <= max(CELLS, n) and len(todo[to][1]) * 1.5 >= n:
            to += 1
        group = todo[at:to]
        sizes = np.array([len(x) for _, x in group])
        places = np.zeros((n, len(group)), int)
        for j, (_, x) in enumerate(group):
            places[: len(x), j] = x
        p = marginals(*forward_backward(table[places], sizes, m.start, m.step))
        p[places == 0] = 0
        mean = p.sum(axis=0) / sizes[:, None]
        rows = [i for i, _ in group]
        langs[rows], scores[rows] = mean.argmax(axis=1), np.clip(mean.max(axis=1), 0, 1)
        at = to

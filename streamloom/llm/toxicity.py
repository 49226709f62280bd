"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, held_out, shingles_of, without, words_of

#: Labelled rows to learn from, at most: those with the least hash of their id.
SAMPLE = 8_000
#: One labelled row in so many is an anchor: its label enters the label model. The others enter with their votes only.
ANCHOR = 4
#: Features that the voters and the classifier choose from: the most telling ones.
FEATURES = 1_024
#: Voters: features that are at least so many times as likely in toxic rows, and are in so many rows at least.
VOTERS, LIFT, LEAST_ROWS = 256, 30.0, 3
#: Evidence that a feature needs, n KL(its share of toxic rows, that of all rows): a share so far from the common one has
#: a chance of exp(-12) at most, also in few rows, so that among 100,000 features of pure chance hardly one gets there.
TELLING = 12.0
#: Lengths of word beginnings that are features besides whole words.
STEMS = (5, 6)
#: Distinct words with one beginning from which on that is a feature of its own.
FAMILY = 3
#: Correlation of two voters within the classes from which on one of them depends on the other.
CORRELATED = 0.2
EM_STEPS, EPOCHS, RIDGE = 30, 300, 1e-3
#: Chance that the label of an anchor is right.
LABEL_ACCURACY = 0.98
#: Words that a task remembers.
REMEMBERED = 50_000
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
#: Patterns of tone, whatever the language: shouting, runs of marks, stretched letters, masked words.
PATTERNS = {
    "#shout": re.compile(r"\b[^\W\d_a-zà-ÿ]{3,}\W+[^\W\d_a-zà-ÿ]{3,}\b"),
    "#marks": re.compile(r"[!?]{2}"),
    "#stretch": re.compile(r"([^\W\d_])\1\1"),
    "#masked": re.compile(r"[^\W\d_][*@$#]+[^\W\d_]"),
}


def features(text: str) -> set[str]:
    """Distinct lower-case words, their beginnings (marked with ``*``, and with ``**`` if ``FAMILY`` words or more have
    them), and the names of patterns that occur."""
    words = set(WORD.findall(text.lower()))
    stems = Counter(w[:n] for w in words for n in STEMS if len(w) > n)
    return words | {s + "*" for s in stems} | {s + "**" for s, n in stems.items() if n >= FAMILY} | {name for name, p in PATTERNS.items() if p.search(text)}


@dataclass
class LabelModel:
    """A generative model of votes. Voter j speaks up in class c with chance ``rate[c, s, j]``, where s is 1 if the voter
    ``parent[j]``, with which it is correlated, has spoken, else 0 (-1: it has none). Silence abstains: it says nothing.
    """

    prior: float
    rate: np.ndarray
    parent: np.ndarray

    def states(self, votes: np.ndarray) -> np.ndarray:
        return np.where(self.parent[None, :] >= 0, votes[:, self.parent], 0)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of the class 1 for each row of votes (0 or 1)."""
        told = np.log(self.rate[1] / self.rate[0])
        odds = np.log(self.prior / (1 - self.prior)) + (votes * np.where(self.states(votes) > 0, told[1], told[0])).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def accuracy(self) -> np.ndarray:
        """Of each voter: the chance that a row is toxic when it speaks up alone."""
        on, off = self.prior * self.rate[1, 0], (1 - self.prior) * self.rate[0, 0]
        return on / (on + off)


def correlated(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The parent of each voter: of those that vote more often, the one whose votes go most along with its own within the
    classes; -1 if none is ``CORRELATED``. Every voter has one parent at most, so that the dependences are trees. The last
    voter speaks where no other does and has none."""
    whole, votes = votes, votes[:, :-1]
    on, off = max(q.sum(), 1e-9), max((1 - q).sum(), 1e-9)
    left = votes - np.outer(q, q @ votes / on) - np.outer(1 - q, (1 - q) @ votes / off)
    sd = np.sqrt(np.maximum((left**2).mean(axis=0), 1e-9))
    corr = left.T @ left / len(q) / np.outer(sd, sd)
    order = np.argsort(-votes.sum(axis=0), kind="stable")
    parent = np.full(whole.shape[1], -1)
    for n, j in enumerate(order[1:].tolist(), 1):
        best = order[:n][np.argmax(corr[j, order[:n]])]
        if corr[j, best] > CORRELATED:
            parent[j] = best
    return parent


def fit_label_model(votes: np.ndarray, anchors: np.ndarray, steps: int = EM_STEPS) -> tuple[LabelModel, np.ndarray]:
    """Expectation maximisation over all rows of ``votes``; ``anchors`` has 1 or 0 where the label is given, else -1.

    It starts from the majority: rows in which the most reliable kind of voter, any but the last, speaks up. Returns the
    model and the posteriors: those of anchors are their labels, those of other rows come from their votes alone.
    """
    given = np.where(anchors == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY)
    q = np.where(anchors >= 0, given, np.where(votes[:, :-1].any(axis=1), 0.9, 0.02))
    # The share of toxic rows is taken from the anchors: votes alone can't tell it.
    prior = float((np.sum(anchors == 1) + 0.5) / (np.sum(anchors >= 0) + 1))
    model = LabelModel(prior, np.zeros((2, 2, votes.shape[1])), np.full(votes.shape[1], -1))
    for step in range(steps):
        if step % 10 == 0:
            model.parent = correlated(votes, q)
        s = model.states(votes)
        for state in (0, 1):
            there = s == state
            spoke = votes * there
            # One row's worth of what both classes do in that state: where little is known, a vote tells little.
            pooled = (spoke.sum(axis=0) + 0.1) / (there.sum(axis=0) + 1)
            for c, w in enumerate((1 - q, q)):
                model.rate[c, state] = (w @ spoke + pooled) / (w @ there + 1)
        q = np.where(anchors >= 0, given, model.posterior(votes))
    return model, q


def fit_linear(rows: list[np.ndarray], n: int, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows (feature numbers) against soft labels, by Adagrad over whole passes."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, int)
    w, bias, gw, gb = np.zeros(n), float(np.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6))), np.full(n, 1e-8), 1e-8
    for _ in range(EPOCHS):
        z = np.bincount(at, w[col], len(rows)) + bias
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / max(len(rows), 1)
        g, b = np.bincount(col, d[at], n) + RIDGE / max(n, 1) * w, d.sum()
        gw += g * g
        gb += b * b
        w -= 0.5 * g / np.sqrt(gw)
        bias -= 0.1 * b / np.sqrt(gb)
    return w, bias


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    voters: list[str]
    label_model: LabelModel | None


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> ToxicityModel:
    """Learn from at most ``SAMPLE`` labelled ids that are not held out; each counts once, with the greatest of its labels
    and the least of its texts, however often it is repeated. Null labels and texts are left out, other columns ignored.

    Spark counts in how many toxic and other rows each word, word beginning and pattern occurs; only the ``FEATURES``
    most telling reach the driver. Those that speak for toxicity are voters: words make the lexicon, beginnings and
    patterns of tone the patterns. One more voter speaks where all of them are silent. The label model estimates from
    their votes, anchored by the labels of a part of the rows, how reliable and correlated they are; the linear
    classifier is trained on its posteriors. Without labelled rows of both classes, or features in enough of them, all
    scores are the share of toxic rows, or nearly 0.
    """
    known = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(doc_id).agg(F.max(toxic).alias("__y")).orderBy(F.xxhash64(doc_id), doc_id).limit(SAMPLE)
    rows = docs.select(doc_id, text).join(F.broadcast(known), doc_id).where(F.col(text).isNotNull())
    anchor = F.pmod(F.xxhash64(doc_id, F.lit(3)), F.lit(ANCHOR)) == 0
    # Copies and near copies agree in the least of their 5-word shingles, mostly: together they weigh as one row.
    least = F.coalesce(F.array_min(shingles_of(F.col("words"), 5)), F.xxhash64("t"))
    one = rows.groupBy(doc_id).agg(F.min(text).alias("t"), (F.max("__y") == 1).alias("y")).select("t", "y", anchor.alias("anchor"), words_of(F.col("t")).alias("words")).withColumn("least", least).drop("words")
    sample = cut(one.withColumn("w", 1 / F.count("*").over(Window.partitionBy("least"))).drop("least"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(features(t)) for t in b.column(0).to_pylist()]
            y, w = (np.repeat(b.column(i).to_numpy(zero_copy_only=False), [len(f) for f in found]) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(w), pa.array([x for f in found for x in f], pa.string())], names=["y", "w", "f"])

    totals = {r[0]: r[1] for r in sample.groupBy("y").agg(F.sum("w")).collect()}
    pos, neg = totals.get(True, 0.0), totals.get(False, 0.0)
    share = pos / (pos + neg) if pos + neg else 0.0
    guess = ToxicityModel({}, float(np.log((share + 1e-6) / (1 - share + 1e-6))), [], None)
    if not pos or not neg:
        return guess
    a, b = F.col("a"), F.col("b")
    part = lambda k, p: F.when(k > 0, k * F.log(k / ((a + b) * p))).otherwise(0.0)
    told = part(a, share) + part(b, 1 - share)
    best = (
        sample.select("t", "y", "w").mapInArrow(tokens, "y boolean, w double, f string")
        .groupBy("f").agg(F.sum(F.col("y").cast("double") * F.col("w")).alias("a"), F.sum((~F.col("y")).cast("double") * F.col("w")).alias("b"))
        .where((a + b >= LEAST_ROWS - 1e-9) & (told >= TELLING)).orderBy(told.desc(), "f").limit(FEATURES).collect()
    )
    if not best:
        return guess
    number = {r["f"]: k for k, r in enumerate(best)}
    voters = [k for k, r in enumerate(best) if r["a"] >= LEAST_ROWS - 1e-9 and (r["a"] / pos) >= LIFT * (r["b"] + 0.5) / neg][:VOTERS]

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(number[f] for f in features(t) & number.keys()) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(3), pa.array(found, pa.list_(pa.int32()))], names=["y", "anchor", "k"])

    seen = sorted((r["y"], r["anchor"], list(r["k"])) for r in sample.select("t", "y", "w", "anchor").mapInArrow(numbers, "y boolean, anchor boolean, k array<int>").collect())
    rows, anchors = [np.array(r[2], int) for r in seen], np.array([int(r[0]) if r[1] else -1 for r in seen])
    place = {k: j for j, k in enumerate(voters)}
    votes = np.zeros((len(rows), len(voters) + 1))
    for i, r in enumerate(rows):
        votes[i, [place[k] for k in r.tolist() if k in place]] = 1
    votes[:, -1] = ~votes.any(axis=1)
    model, q = fit_label_model(votes, anchors)
    w, bias = fit_linear(rows, len(number), q)
    return ToxicityModel({f: float(w[k]) for f, k in number.items() if abs(w[k]) > 1e-6}, bias, [best[k]["f"] for k in voters], model)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with ``score``, 0 to 1, from whole texts; null and empty texts get the score of no evidence. Rows, repeated
    ones too, and other columns stay as they are; a column that is already named like the score is replaced, an empty
    table gives no rows. Of a long text the distinct words are held at a time."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    kept = without(docs, score)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        get, memory = weights.get, {}
        patterns = [(weights[name], p.search) for name, p in PATTERNS.items() if name in weights]
        for b in batches:
            z = np.empty(b.num_rows)
            for n, t in enumerate(b.column(text)):
                if (t := t.as_py()) is None:
                    z[n] = bias
                    continue
                # Every distinct word adds its own weight; a beginning adds its weight once, and once more for a family.
                whole, stems = 0.0, Counter()
                for w in set(WORD.findall(t.lower())):
                    if (known := memory.get(w)) is None:
                        if len(memory) >= REMEMBERED:
                            memory.clear()
                        known = memory[w] = (get(w, 0.0), tuple(s for k in STEMS if len(w) > k and ((s := w[:k]) + "*" in weights or s + "**" in weights)))
                    whole += known[0]
                    if known[1]:
                        stems.update(known[1])
                z[n] = bias + whole + sum(get(s + "*", 0.0) + (get(s + "**", 0.0) if stems[s] >= FAMILY else 0.0) for s in sorted(stems)) + sum(v for v, search in patterns if search(t))
            out = pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], out], names=[*names, score])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(score, T.DoubleType(), False)]))

"""Byte-level BPE encoding and decoding as a tree reduction over texts."""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import without

#: Characters of text, bytes of a pretoken and ids that are handled in one go; more of them are halved.
LEAF_CHARS, LEAF, LEAF_IDS = 1024, 48, 4096
#: Pretokens of at most LEAF characters that an encoder remembers, twice at most: about 15 MB each.
REMEMBERED = 70_000
#: Pairs of tokens whose stability it remembers.
PAIRS = 20_000
#: Characters of text that are encoded at a time, about, and pretokens that are merged at a time.
CHUNK_CHARS, ABREAST = 1 << 19, 4096
#: Rank of a pair that is no token.
NONE = np.int32(2**31 - 1)


class _Memory(dict):
    """Encodings of pretokens, made when first asked for. When it is full, those not asked for since it was last full go."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= LEAF:
            self.room(1)
            self[piece] = ids
        return ids

    def room(self, n: int) -> None:
        if len(self) + n > REMEMBERED:
            self.old = self.copy()
            self.clear()


class Part(NamedTuple):
    """The encoding of a stretch of a text on its own: where its pretokens end in the text, how many bytes of ids each of
    them has, and the ids, 32 bits each in the machine's order, so that joining is concatenation."""

    ends: array
    sizes: array
    ids: bytes


def halves(a: int, b: int) -> Iterator[tuple[int, int]]:
    """The leaves of the tree over the characters from a to b."""
    if b - a <= LEAF_CHARS:
        yield a, b
    else:
        yield from halves(a, (a + b) // 2)
        yield from halves((a + b) // 2, b)


class ByteBpe:
    """Encoder and decoder for one vocabulary.

    ``ranks`` are the lines of a rank file (base64 of the token's bytes, its rank); ``pattern`` cuts a text into
    pretokens, which are encoded one by one, without special tokens. Of a pattern it takes: its matches leave no
    character out, nothing in it looks back or for line ends, and no match depends on what comes more than ``reach``
    characters after its end (a run of one class and what follows it, a contraction). Others raise ValueError.
    """

    def __init__(self, ranks: bytes, pattern: str, reach: int = 4):
        import regex

        if regex.search(r"\(\?<[=!]|\\[AbBGKmMzZ]|(?<![\[\\])\^|(?<!\\)\$", pattern):
            raise ValueError("the pattern looks back or for edges of the text: parts of a text can't be matched on their own")
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.token = {r: b for b, r in self.rank.items()}
        self.pattern, self.reach = regex.compile(pattern), reach
        self.agree: dict[tuple[int, int], bool] = {}
        self.known = _Memory(self.one)
        # Pairs of tokens that make a token, as sorted numbers, and its rank; a token's number is its rank.
        pairs = {(a << 32) + b: r for t, r in self.rank.items() for i in range(1, len(t)) if (a := self.rank.get(t[:i])) is not None and (b := self.rank.get(t[i:])) is not None}
        self.pairs = np.sort(np.fromiter(pairs, np.int64, len(pairs)))
        self.makes = np.array([pairs[p] for p in self.pairs.tolist()] + [NONE], np.int32)
        self.bytes = np.array([self.rank[bytes([x])] for x in range(256)], np.int32)

    # -- the reduction over the bytes of one pretoken

    def merge(self, piece: bytes) -> list[int]:
        """Merge the neighbours of lowest rank, leftmost first, until none are left."""
        if len(piece) > 2 * LEAF:
            return self._merge_long(piece)
        rank, top = self.rank.get, 1 << 60
        edges = list(range(len(piece) + 1))
        ranks = [rank(piece[i : i + 2], top) for i in range(len(piece) - 1)]
        while ranks and (best := min(ranks)) < top:
            i = ranks.index(best)
            del ranks[i], edges[i + 1]
            if i < len(ranks):
                ranks[i] = rank(piece[edges[i] : edges[i + 2]], top)
            if i:
                ranks[i - 1] = rank(piece[edges[i - 1] : edges[i + 1]], top)
        return [self.rank[piece[a:b]] for a, b in zip(edges, edges[1:], strict=False)]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of candidate merges, for windows that have grown."""
        end, after, before = list(range(1, len(piece) + 1)), list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
        heap = [(r, i, i + 2) for i in range(len(piece) - 1) if (r := self.rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i]
            if end[i] < 0 or j >= len(piece) or end[j] != to:
                continue
            end[i], after[i], end[j] = to, after[j], -1
            if after[i] < len(piece):
                before[after[i]] = i
                if (r := self.rank.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := self.rank.get(piece[h:to])) is not None:
                heapq.heappush(heap, (r, h, to))
        return [self.rank[piece[i : end[i]]] for i in range(len(piece)) if end[i] > 0]

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay two tokens side by side. If all neighbours in a row do, the row is the encoding."""
        if (known := self.agree.get((a, b))) is None:
            if len(self.agree) >= PAIRS:
                self.agree.clear()
            known = self.agree[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def join(self, left: Sequence[int], right: Sequence[int]) -> list[int]:
        """Encoding of two byte strings in a row, from theirs: the window at the seam is encoded anew and grows on the
        side where its edge and the token outside are not stable."""
        i, j = min(1, len(left)), min(1, len(right))
        while True:
            window = self.merge(b"".join(self.token[t] for t in [*left[len(left) - i :], *right[:j]]))
            grow_left = i < len(left) and not self.stable(left[-i - 1], window[0])
            grow_right = j < len(right) and not self.stable(window[-1], right[j])
            if not grow_left and not grow_right:
                return [*left[: len(left) - i], *window, *right[j:]]
            i = min(len(left), 2 * i) if grow_left else i
            j = min(len(right), 2 * j) if grow_right else j

    def reduce(self, piece: bytes) -> list[int]:
        """Encode halves and join them."""
        if len(piece) <= LEAF:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.reduce(piece[:half]), self.reduce(piece[half:]))

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs make, NONE if none; b is -1 where there is no neighbour."""
        key = (a.astype(np.int64) << 32) + b
        at = np.searchsorted(self.pairs, key)
        at[self.pairs[np.minimum(at, len(self.pairs) - 1)] != key] = len(self.pairs)
        return self.makes[at]

    def merge_abreast(self, pieces: list[bytes]) -> list[bytes]:
        """As ``merge``, for many short byte strings side by side: each round merges one pair of each of them."""
        sizes = np.array([len(p) for p in pieces])
        wide = np.arange(int(sizes.max()) + 1)
        inside = wide[None, :] < sizes[:, None]
        ids = np.full(inside.shape, -1, np.int32)
        ids[inside] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full(inside.shape, NONE, np.int32)
        paired = inside[:, 1:]
        ranks[:, :-1][paired] = self._ranks(ids[:, :-1][paired], ids[:, 1:][paired])
        out, row = np.full_like(ids, -1), np.arange(len(pieces))
        while len(row):
            here = np.arange(len(row))
            i = ranks.argmin(axis=1)
            best = ranks[here, i]
            if (over := best == NONE).any():
                out[row[over], : ids.shape[1]] = ids[over]
                left = ~over
                row, ids, ranks, i, best = row[left], ids[left], ranks[left], i[left], best[left]
                here = np.arange(len(row))
            # Take the right one of the pair out, then look its neighbours up anew.
            right = wide[None, : ids.shape[1] - 1] > i[:, None]
            ids[:, :-1] = np.where(right, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(right, ranks[:, 1:], ranks[:, :-1])
            ids, ranks = ids[:, :-1], ranks[:, :-1]
            ids[here, i] = best
            behind = np.minimum(i + 1, ids.shape[1] - 1)
            ranks[here, i] = self._ranks(best, np.where(behind > i, ids[here, behind], -1))
            inner = i > 0
            ranks[here[inner], i[inner] - 1] = self._ranks(ids[here[inner], i[inner] - 1], best[inner])
        flat, ends = out[out >= 0].tobytes(), 4 * np.cumsum((out >= 0).sum(axis=1))
        return [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def learn(self, pretokens: set[str]) -> None:
        """Encode those that are not known."""
        fresh = [p for p in pretokens.difference(self.known) if p not in self.known.old and len(p) <= LEAF]
        raws = [p.encode() for p in fresh]
        todo = sorted([(len(r), r, p) for r, p in zip(raws, fresh, strict=True) if r not in self.rank and len(r) <= LEAF])
        self.known.room(len(todo))
        for at in range(0, len(todo), ABREAST):
            part = todo[at : at + ABREAST]
            self.known.update(zip([p for _, _, p in part], self.merge_abreast([r for _, r, _ in part]), strict=True))

    def one(self, pretoken: str) -> bytes:
        raw = pretoken.encode()
        whole = self.rank.get(raw)
        return array("i", [whole] if whole is not None else self.reduce(raw)).tobytes()

    # -- the reduction over the characters of a text

    def leaf(self, pieces: list[str], a: int, b: int) -> Part:
        coded = list(map(self.known.__getitem__, pieces))
        ends = array("q", accumulate(map(len, pieces), initial=a))
        if ends.pop(0) != a or (ends[-1] if ends else a) != b:
            raise ValueError("the pattern leaves characters out")
        return Part(ends, array("q", map(len, coded)), b"".join(coded))

    def join_parts(self, text: str, a: int, left: Part, seam: int, right: Part, b: int) -> Part:
        """Encoding of text[a:b] from those of text[a:seam] and text[seam:b].

        Pretokens that end ``reach`` or more before the seam stay: what they depend on was there. From the first other
        one on, the window of text is matched anew, and grows until a match begins where one of the right part does:
        from there on all matches are those of the right part. A pretoken across the seam is joined from the tokens on
        both sides of it.
        """
        keep = len(left.ends)
        while keep and left.ends[keep - 1] > seam - self.reach:
            keep -= 1
        start = left.ends[keep - 1] if keep else a
        ends, coded, skip, next_start = array("q"), [], 0, seam
        for m in self.pattern.finditer(text, start, b):
            s, e = m.span()
            while skip < len(right.ends) and next_start < s:
                next_start = right.ends[skip]
                skip += 1
            if s == next_start:
                break
            coded.append(self._across(text, a, s, left, seam, right, e) if s < seam < e else self.known[m.group()])
            ends.append(e)
        else:
            skip = len(right.ends)
        gone, done = sum(left.sizes[keep:]), sum(right.sizes[:skip])
        return Part(
            left.ends[:keep] + ends + right.ends[skip:],
            left.sizes[:keep] + array("q", map(len, coded)) + right.sizes[skip:],
            b"".join([left.ids[: len(left.ids) - gone], *coded, right.ids[done:]]),
        )

    def _across(self, text: str, a: int, s: int, left: Part, seam: int, right: Part, e: int) -> bytes:
        """Ids of the pretoken text[s:e] with the seam inside: joined from pretokens that end and begin there, if so."""
        last = (left.ends[-2] if len(left.ends) > 1 else a) == s
        ids = [array("i"), array("i")]
        ids[0].frombytes(left.ids[len(left.ids) - left.sizes[-1] :] if last else self.known[text[s:seam]])
        ids[1].frombytes(right.ids[: right.sizes[0]] if right.ends[0] == e else self.known[text[seam:e]])
        return array("i", self.join(*ids)).tobytes()

    def part(self, text: str, a: int, b: int, leaves: Iterator[list[str]]) -> Part:
        """Encode halves and join them; ``leaves`` has the pretokens of one leaf after the other."""
        if b - a <= LEAF_CHARS:
            return self.leaf(next(leaves), a, b)
        seam = (a + b) // 2
        left = self.part(text, a, seam, leaves)
        return self.join_parts(text, a, left, seam, self.part(text, seam, b, leaves), b)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of some texts: new pretokens of all their leaves are merged side by side, then each text's tree is joined."""
        leaves = [[self.pattern.findall(t, a, b) for a, b in halves(0, len(t))] for t in texts]
        self.learn(set(chain.from_iterable(chain.from_iterable(leaves))))
        return [self.part(t, 0, len(t), iter(found)).ids for t, found in zip(texts, leaves, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of ids, concatenated up the tree."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """``docs`` with the column ``ids`` (array of int) and, unless None, ``decoded`` (binary: what the ids say again).

    Null texts count as empty: no ids, no bytes. Columns that already have these names are replaced, others kept;
    repeated rows are encoded like any others, an empty table gives no rows. Texts are never cut off: a long one takes
    memory in proportion to its length, a few dozen bytes a word. Rows stay in their partitions, nothing is shuffled.
    ``ranks_path`` is read once, by the driver, and sent to the executors; each task makes an encoder of its own and
    drops it with its memory, which is bounded.
    """
    from pyspark.sql import types as T

    with open(ranks_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = without(docs, *([ids] if ids.lower() != text.lower() else []), *([decoded] if decoded and decoded.lower() != text.lower() else []))
    new = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.BinaryType(), False)] if decoded else [])
    carried = [c for c in kept.columns if c.lower() not in {f.name.lower() for f in new}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(sent.value, pattern)
        for batch in batches:
            column, start = batch.column(text), 0
            while start < batch.num_rows:
                texts, size = [], 0
                while start + len(texts) < batch.num_rows and (not texts or size < CHUNK_CHARS):
                    texts.append(column[start + len(texts)].as_py() or "")
                    size += len(texts[-1])
                rows = bpe.encode_all(texts)
                flat, ends = np.frombuffer(b"".join(rows), np.int32), np.cumsum([0] + [len(r) // 4 for r in rows], dtype=np.int32)
                arrays = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    listed = flat.tolist()
                    arrays.append(pa.array([bpe.decode(listed[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()))
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carried] + arrays, names=[*carried, *[f.name for f in new]])
                start += len(texts)

    schema = T.StructType([*[docs.schema[c] for c in carried], *new])
    return docs.select(*carried, *([text] if text not in carried else [])).mapInArrow(run, schema)

"""Hashes of word shingles and their minima, with numpy, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes other than space and \\t to \\r), and where they begin."""
    b = np.frombuffer(raw, np.uint8)
    dark = ~_SPACE[b]
    edge = np.diff(dark.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, np.uint64), begin
    # A polynomial over each word: byte values times a power of the base that restarts with the word.
    place = np.arange(len(b))
    place[begin[0] :] -= np.repeat(begin, np.diff(np.append(begin, len(b))))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(place.max(initial=0)), _BASE)]), dtype=np.uint64)
        value = _BYTE[b] * power[place] * dark
        sums = np.add.reduceat(value, begin)
    return mixed(sums), begin


def row_shingles(texts: list[str | None], k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For texts from a to b, a chunk at a time: (a, b, hashes of all their shingles, where each text's begin and end).

    A text of fewer than ``k`` words, but at least one, has one shingle: all its words.
    """
    a = 0
    while a < len(texts):
        raws, size, b = [], 0, a
        while b < len(texts) and (b == a or size < CHUNK):
            raws.append((texts[b] or "").encode("utf-8", "replace"))
            size += len(raws[-1]) + 1
            b += 1
        words, begin = word_hashes(b"\n".join(raws))
        starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
        first = np.searchsorted(begin, starts)
        with np.errstate(over="ignore"):
            n = len(words)
            padded = np.concatenate([words, np.zeros(k, np.uint64)])
            rolled = np.zeros(n, np.uint64)
            for j in range(k):
                rolled = rolled * _STEP + padded[j : j + n]
        rolled = mixed(rolled)
        counts = np.diff(first)
        take = np.maximum(counts - k + 1, np.minimum(counts, 1))
        ends = np.cumsum(take)
        at = np.repeat(first[:-1] - (ends - take), take) + np.arange(ends[-1] if len(ends) else 0)
        out = rolled[at]
        for i in np.flatnonzero((counts > 0) & (counts < k)):
            h = np.uint64(counts[i])
            with np.errstate(over="ignore"):
                for w in words[first[i] : first[i + 1]]:
                    h = h * _STEP + w
            out[ends[i] - 1] = mixed(np.array([h]))[0]
        yield a, b, out, np.concatenate([[0], ends])
        a = b


def minima(shingles: np.ndarray, ends: np.ndarray, perms: np.ndarray) -> np.ndarray:
    """MinHash: for each text (row) and permutation (column) the least value; all ones for texts without shingles."""
    out = np.full((len(ends) - 1, len(perms)), np.iinfo(np.uint64).max, np.uint64)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        for j, p in enumerate(perms):
            # One multiplication and a shift scramble the upper bits, which decide the order.
            with np.errstate(over="ignore"):
                out[full, j] = np.minimum.reduceat((shingles ^ p) * (p | np.uint64(1)), ends[full])
    return out


def permutations(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64)
